"""Errors of the library."""


class TileError(ValueError):
    """Base of all errors raised here."""


class CodecError(TileError):
    """A band cannot be decompressed or has the wrong length."""


class UnsupportedCodecError(CodecError):
    """The codec needs a package that is not installed."""


class PixelTypeError(TileError):
    """Not a pixel type."""


class GeometryError(TileError):
    """Text that is no well-known geometry, or a geometry that a function does not take."""


class MetadataError(TileError):
    """A table without a readable metadata document."""
