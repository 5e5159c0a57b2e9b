"""Pre-tokens of a SentencePiece model, which can be encoded one by one.

A unit is a run of spaces with the non-spaces after it, cut at line ends. If no piece of
the model holds a space mark after another character, and none holds a line end, no piece
crosses a unit's border, so a text's encoding is that of its units in a row: for BPE
merges as for the best path. ``check_units`` proves this for a given model.
"""

from __future__ import annotations

import re

import sentencepiece
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
units_of = re.compile(r" *[^ \n]+|\n| +").findall

UNKNOWN, CONTROL, BYTE = 2, 3, 6  # the format's fixed piece types


def load_model(path: str) -> sentencepiece_model_pb2.ModelProto:
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def check_units(model: sentencepiece_model_pb2.ModelProto) -> None:
    """Raise unless every text of this model splits into units without loss."""
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("the model normalises texts; units need identity and a dummy prefix")
    for p in model.pieces:
        if p.type in (UNKNOWN, CONTROL, BYTE):
            continue
        if p.type != 1 or MARK in p.piece.lstrip(MARK) or "\n" in p.piece:
            raise ValueError(f"the piece {p.piece!r} may cross a unit's border")
    if not any(p.type == BYTE and p.piece == "<0x0A>" for p in model.pieces):
        raise ValueError("a line end must be a byte piece")


def split_units(text: str) -> list[str]:
    """The units of a text, the model's dummy prefix in front; none for an empty text."""
    if not text:
        return []
    if MARK in text:  # the model writes spaces so, and can't tell the two apart
        text = text.replace(MARK, " ")
    return units_of(" " + text)
