"""Relational operators of the domain.

Each is a lazy DataFrame transformation over the domain's tables, for one team or, without a team, for all
at once. None runs an action. Orders are total: where the domain leaves ties open, the last sort key is an id
or a name.
"""
