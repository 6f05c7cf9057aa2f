"""larkmill.sources"""
