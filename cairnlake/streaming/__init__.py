"""cairnlake.streaming"""
