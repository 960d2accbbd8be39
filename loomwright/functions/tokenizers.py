"""Tokenizers from vocabulary files, as column functions on Arrow batches. Nothing is trained here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.BooleanType())), T.StructField("overflow", T.IntegerType())])


def _encoder(load, size: int | None, pad_id: int):
    @F.pandas_udf(_ENCODED)
    def encode(texts: pd.Series) -> pd.DataFrame:
        tokenizer = load()
        out = []
        for ids in (e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            n = len(ids) if size is None else size
            kept = ids[:n]
            out.append((kept + [pad_id] * (n - len(kept)), [True] * len(kept) + [False] * (n - len(kept)), max(0, len(ids) - n)))
        return pd.DataFrame(out, columns=["ids", "mask", "overflow"])

    return encode


def json_tokenizer(path: str, size: int | None = None, pad_id: int = 0, **components):
    """A function of a text column to struct(ids, mask, overflow): the tokenizer of a JSON file, ids cut or padded to size.

    overflow is the number of tokens cut. The file is read on the executors, so it must be there. Components replace the
    file's: normalizer, pre_tokenizer, post_processor, decoder, each a function without arguments that makes one.
    """
    if unknown := set(components) - {"normalizer", "pre_tokenizer", "post_processor", "decoder"}:
        raise ValueError(f"no components of a tokenizer: {sorted(unknown)}")

    def load():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for name, make in components.items():
            setattr(tokenizer, name, make())
        return tokenizer

    return _encoder(load, size, pad_id)


def wordpiece_tokenizer(vocabulary: dict[str, int], unknown: str = "[UNK]", size: int | None = None, pad_id: int = 0):
    """The same for a WordPiece vocabulary, of words between blanks."""

    def load():
        from tokenizers import Tokenizer
        from tokenizers.models import WordPiece
        from tokenizers.pre_tokenizers import Whitespace

        tokenizer = Tokenizer(WordPiece(vocabulary, unk_token=unknown))
        tokenizer.pre_tokenizer = Whitespace()
        return tokenizer

    return _encoder(load, size, pad_id)


def top_token(vocabulary: dict[str, int]) -> tuple[str, int]:
    """The token with the highest id."""
    return max(vocabulary.items(), key=lambda item: item[1])


def sentinel_range(vocabulary: dict[str, int], prefix: str = "<SENTINEL_ID") -> tuple[int, int]:
    """The lowest and highest number in the tokens that contain the prefix."""
    import re

    found = [re.findall(r"\d+", t) for t in vocabulary if prefix in t]
    if not found or any(len(f) != 1 for f in found):
        raise ValueError(f"no sentinels {prefix}, or one without exactly one number")
    numbers = [int(f[0]) for f in found]
    return min(numbers), max(numbers)
