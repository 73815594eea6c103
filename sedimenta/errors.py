"""Refusals: a whole call stops, and nothing of it is published."""


class Refused(ValueError):
    """Input or stored data breaks a rule."""


class LimitExceeded(Refused):
    """A declared bound is passed."""


class StaleBase(Refused):
    """A dataset has moved on from the state that a change was made for."""
