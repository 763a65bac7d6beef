"""cairnlake.sources"""
