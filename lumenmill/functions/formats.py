"""What image decoders refuse."""


class UnsupportedFormat(ValueError):
    """A file of no known format, or one of a kind that is not read."""
