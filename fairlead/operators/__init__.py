"""fairlead.operators"""
