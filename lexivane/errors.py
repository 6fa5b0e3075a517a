"""What goes wrong, by where it does."""


class EngineError(Exception):
    """Any failure of the engine."""


class InsertError(EngineError):
    """Rows don't fit their table: wrong columns, or a key that is there already."""


class LoadError(EngineError):
    """A stored table or dictionary can't be read or written."""


class RowError(EngineError):
    """A table that exists can't be made, or one that doesn't can't be written to; or an argument is out of range."""


class EncodeError(EngineError):
    """Text can't be turned into word ids."""


class FetchError(EngineError):
    """A page can't be had, or holds no article."""
