"""Documents as rows of text: one reader per kind of file, chosen by its extension.

Files are listed and read by Spark; each is parsed in the task that holds it.
Office files are zipped XML, of which the text is taken in reading order.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet that are read, and bytes that a part of an office file may have
#: once it is unpacked.
SHEET_ROWS, PART_BYTES = 100_000, 256 << 20
#: Extensions of source code, with the language that heads the text.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "scala": "scala", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "sh": "bash", "sql": "sql", "r": "r", "kt": "kotlin", "swift": "swift", "lua": "lua", "toml": "toml",
}
DOCUMENT = "path string, kind string, section string, text string, error string"


def _plain(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("\ufeff")


def _markup(text: str) -> str:
    """Text of tags-and-text without declarations; entities are not expanded."""
    return re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text, flags=re.IGNORECASE)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(data: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(_markup(_plain(data)))


def _parts(data: bytes, pattern: str) -> Iterator[tuple[str, bytes]]:
    """Members of a zip whose name matches, numbered ones by number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        for name in sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            if z.getinfo(name).file_size > PART_BYTES:
                raise ValueError(f"{name} is larger than {PART_BYTES} bytes")
            yield name, z.read(name)


def _paragraphs(root: ElementTree.Element, paragraph: str, run: str) -> str:
    """The runs of each paragraph joined, a line a paragraph."""
    lines = ("".join(t.text or "" for t in p.iter() if _local(t.tag) == run) for p in root.iter() if _local(p.tag) == paragraph)
    return "\n".join(line for line in lines if line.strip())


def text_file(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    head = f"Language: {LANGUAGES[ext]}\n\n" if ext in LANGUAGES else ""
    yield "", head + _plain(data)


def json_file(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    """A section per line or list element; an object is one section."""
    if ext in ("jsonl", "ndjson"):
        for k, line in enumerate(_plain(data).splitlines(), 1):
            if line.strip():
                yield f"line {k}", json.dumps(json.loads(line), ensure_ascii=False)
        return
    found = json.loads(_plain(data))
    for k, item in enumerate(found if isinstance(found, list) else [found], 1):
        yield f"item {k}", json.dumps(item, ensure_ascii=False)


def xml_file(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    """Tag and text of each element that has text, a line each."""
    yield "", "\n".join(f"{_local(e.tag)}: {e.text.strip()}" for e in _xml(data).iter() if e.text and e.text.strip())


def notebook(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    for k, cell in enumerate(json.loads(_plain(data)).get("cells", []), 1):
        source = cell.get("source", "")
        yield f"{cell.get('cell_type', 'cell')} {k}", "".join(source) if isinstance(source, list) else source


def docx(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    for _, part in _parts(data, r"word/document\.xml"):
        yield "", _paragraphs(_xml(part), "p", "t")


def pptx(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    for k, (_, part) in enumerate(_parts(data, r"ppt/slides/slide\d+\.xml"), 1):
        yield f"slide {k}", _paragraphs(_xml(part), "p", "t")


def epub(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    for k, (_, part) in enumerate(_parts(data, r".*\.x?html?"), 1):
        text = re.sub(r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ", _plain(part))
        yield f"chapter {k}", re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", text)).strip()


def xlsx(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    """A section per sheet, a line per row, cells set apart by tabs."""
    shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for _, part in _parts(data, r"xl/sharedStrings\.xml") for s in _xml(part) if _local(s.tag) == "si"]
    for k, (_, part) in enumerate(_parts(data, r"xl/worksheets/sheet\d+\.xml"), 1):
        lines = []
        for row in (r for r in _xml(part).iter() if _local(r.tag) == "row"):
            if len(lines) == SHEET_ROWS:
                raise ValueError(f"sheet {k} has more than {SHEET_ROWS} rows: save it as CSV")
            cells = []
            for cell in (c for c in row if _local(c.tag) == "c"):
                value = next((v.text or "" for v in cell.iter() if _local(v.tag) in ("v", "t")), "")
                cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
            lines.append("\t".join(cells))
        yield f"sheet {k}", "\n".join(lines)


def rtf(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    """Text without control words and groups that hold no text."""
    text = re.sub(r"\{\\(\*|fonttbl|colortbl|stylesheet|info)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "", _plain(data))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\par[d]?\b ?", "\n", text)
    yield "", re.sub(r"\n{2,}", "\n", re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text)).strip()


def latex(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    """Sections of the body, without comments and commands."""
    text = re.sub(r"(?<!\\)%.*", "", _plain(data))
    body = re.search(r"(?s)\\begin\{document\}(.*?)(\\end\{document\}|$)", text)
    parts = re.split(r"\\(?:sub)*section\*?\{([^{}]*)\}", body[1] if body else text)
    for title, part in zip(["", *parts[1::2]], parts[::2], strict=True):
        bare = re.sub(r"\\[a-zA-Z]+\*?(\[[^\]]*\])?", "", part)
        if bare := re.sub(r"[ \t]*\n\s*\n\s*", "\n\n", re.sub(r"[{}~]", " ", bare)).strip():
            yield title, bare


def bibtex(data: bytes, ext: str) -> Iterator[tuple[str, str]]:
    for entry in re.finditer(r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\}", _plain(data)):
        fields = re.findall(r"(\w+)\s*=\s*[{\"](.*?)[}\"]\s*(?:,|$)", entry[3], flags=re.DOTALL)
        yield entry[2], "\n".join([entry[1].lower(), *(f"{k.lower()}: {re.sub(r'[{}]', '', v)}" for k, v in fields)])


#: Reader by extension.
READERS: dict[str, Callable[[bytes, str], Iterator[tuple[str, str]]]] = {
    **dict.fromkeys(("md", "markdown", "txt", "text", "log", "rst", "yaml", "yml", "csv", "tsv", *LANGUAGES), text_file),
    **dict.fromkeys(("json", "jsonl", "ndjson"), json_file),
    "xml": xml_file, "ipynb": notebook, "docx": docx, "pptx": pptx, "xlsx": xlsx, "epub": epub, "rtf": rtf, "tex": latex, "bib": bibtex,
}
#: Kinds that are refused with a reason.
REFUSED = {"xls": "save the workbook as .xlsx", "doc": "save the document as .docx", "ppt": "save the slides as .pptx"}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split(" ")[0], pa.string()) for c in DOCUMENT.split(", ")])
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ext = path.rpartition("/")[2].rpartition(".")[2].lower()
            rows, error = [], None
            if ext in REFUSED or ext not in READERS:
                error = REFUSED.get(ext, f"no reader for .{ext}")
            else:
                try:
                    rows = [(path, ext, section, text, None) for section, text in READERS[ext](data.as_py() or b"", ext)]
                except Exception as broken:  # noqa: BLE001 - one bad file must not end the job; its row says why
                    error = f"{type(broken).__name__}: {broken}"
            rows += [(path, ext, None, None, error)] if error else []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5, schema=schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, section, text, error): the text of every file under ``path`` by
    section. A file that has no reader or can't be read gives one row with the
    error; empty files give none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read, DOCUMENT)


def described(documents: DataFrame) -> DataFrame:
    """One row per file: kind, sections, characters, a digest of its text, and the error."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n")
    return documents.groupBy("path", "kind").agg(F.count("text").alias("sections"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.sha2(listed, 256).alias("content_hash"), F.max("error").alias("error"))
