"""larkmill.operators"""
