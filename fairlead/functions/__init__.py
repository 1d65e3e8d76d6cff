"""fairlead.functions"""
