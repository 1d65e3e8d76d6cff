"""fairlead.sources"""
