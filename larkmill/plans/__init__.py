"""larkmill.plans"""
