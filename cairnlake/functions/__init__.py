"""cairnlake.functions"""
