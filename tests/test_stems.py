"""Stems against published pairs of the algorithm."""

from cairnlake.functions.stems import ENGLISH_STOP, with_stems

#: Pairs from the algorithm's published sample vocabulary, and one or more for each rule.
PAIRS = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist,
consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol,
consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson, consort consort, consorted consort,
consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir,
conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, constant constant, knack knack, knackeries knackeri, knacks knack, knag knag,
knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell,
knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive,
knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot,
caresses caress, ponies poni, ties tie, cries cri, gas gas, this this, gaps gap, kiwis kiwi, agreed agre, feed feed, plastered plaster, bled bled, motoring motor, sing sing,
conflated conflat, troubled troubl, sized size, hopping hop, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, hoping hope, happy happi, say say, by by, cry cri,
enjoy enjoy, youth youth, boyish boyish, relational relat, conditional condit, rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform,
radicalli radic, differentli differ, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope,
callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative format, formalize formal, electriciti electr, electrical electr,
hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit,
replacement replac, adjustment adjust, dependent depend, adoption adopt, communism communism, activate activ, angulariti angular, homologous homolog, effective effect,
bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, generate generat, generation generat, general general, generous generous,
communication communic, communal communal, arsenal arsenal, apology apolog, apologies apolog, fluently fluentli, quickly quick, skies sky, dying die, news news, innings inning,
herring herring, exceeded exceed, proceed proceed, succeeds succeed, bias bias, early earli, only onli, running run, runner runner, ran ran, national nation, nationally nation"""


def test_published_pairs(spark):
    pairs = [tuple(x.split()) for x in PAIRS.replace("\n", " ").split(",")]
    got = {r["word"]: r["stem"] for r in with_stems(spark.createDataFrame(pairs, "word string, want string")).collect()}
    wrong = {w: (got[w], want) for w, want in pairs if got[w] != want}
    assert not wrong


def test_other_words(spark):
    words = [("ox",), ("a1s",), ("naïves",), ("",), (None,), ("y",), ("yes",)]
    got = {r["word"]: r["stem"] for r in with_stems(spark.createDataFrame(words, "word string")).collect()}
    assert got == {"ox": "ox", "a1s": "a1s", "naïves": "naïves", "": "", None: None, "y": "y", "yes": "yes"}
    assert len(ENGLISH_STOP) == len(set(ENGLISH_STOP)) == 127
