"""fairlead.plans"""
