"""larkmill.functions"""
