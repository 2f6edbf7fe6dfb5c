"""Errors. A ``TileError`` concerns one tile of a batch and becomes its payload; any other fails the request."""


class TilesetError(Exception):
    """Anything a tileset refuses."""


class TilesetUnavailable(TilesetError):
    """The tileset itself cannot be served."""


class MalformedTileId(TilesetError):
    """The request cannot be understood."""


class UnsupportedModifier(MalformedTileId):
    """A modifier the tileset does not declare."""


class UnsupportedOption(MalformedTileId):
    """An option the tileset does not declare."""


class TileError(TilesetError):
    """One tile cannot be served; its siblings can."""

    def payload(self) -> dict[str, str]:
        return {"error": str(self), "error_type": type(self).__name__}


class TileOutOfBounds(TileError):
    """No such zoom level or position."""


class TileTooWide(TileError):
    """Wider than the policy's ``max_span``."""


class TileTooLarge(TileError):
    """The scan would read more than the policy's ``max_scan_bytes``."""
