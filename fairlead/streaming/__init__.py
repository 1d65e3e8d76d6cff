"""fairlead.streaming"""
