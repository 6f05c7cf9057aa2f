"""larkmill.streaming"""
