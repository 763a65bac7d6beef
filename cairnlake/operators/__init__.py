"""cairnlake.operators"""
