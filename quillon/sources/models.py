"""Embedders and decoders by name."""

from __future__ import annotations

from importlib import import_module

from .media import Decoder, Embedder, HashingEmbedder

EMBEDDERS = {"hashing": HashingEmbedder}


def embedder(name: str, dims: int = 64) -> Embedder:
    """A registered name, or ``module:maker`` for a maker of one's own; both are called with the number of dimensions."""
    if name in EMBEDDERS:
        return EMBEDDERS[name](dims)
    if ":" not in name:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(sorted(EMBEDDERS))}, and module:maker for others")
    return _made(name, dims)


def decoder(name: str, most_pixels: int) -> Decoder:
    """``module:maker``, called with the number of pixels that pictures are shrunk to."""
    if ":" not in name:
        raise ValueError(f"a decoder is module:maker, not {name!r}")
    return _made(name, most_pixels)


def _made(name: str, *given):
    module, _, maker = name.partition(":")
    return getattr(import_module(module), maker)(*given)
