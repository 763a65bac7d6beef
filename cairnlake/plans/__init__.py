"""cairnlake.plans"""
