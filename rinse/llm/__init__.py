"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this package.  Each module holds one
operator (its general interface works on any DataFrame with the documented
columns); ``queries`` binds the operators to the driver's tables.
"""
