"""The one exception raised for problems a user can fix."""


class MaillodeError(Exception):
    """A missing mail directory, an index that was never built, a bad argument."""
