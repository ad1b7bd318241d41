"""Generated conversations for load tests."""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_CHARACTERS = 8192
_TEXTS = 256  # texts that a task makes at a time
_PER_DIGEST = 21  # base64 characters that a 128-bit digest fills completely


def random_text(key: Column, characters: int) -> Column:
    """Letters, digits and spaces drawn from digests of ``key:block``, all 63 equally likely.

    Each base64 character is one of 64: ``+`` stands for the space, ``/`` is dropped. The spare
    blocks cover the dropped ones; the text is cut to length.
    """
    expected = characters / _PER_DIGEST * 64 / 63
    blocks = int(expected + 8 * (expected**0.5)) + 8
    places = [str(b).encode() for b in range(blocks)]
    spaces = bytes.maketrans(b"+", b" ")

    @F.arrow_udf("string")
    def drawn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        padded = np.zeros((blocks, 18), np.uint8)  # a digest and two bytes are 24 base64 characters
        for keys in batches:
            for start in range(0, len(keys), _TEXTS):
                texts = []
                for value in keys.slice(start, _TEXTS).to_pylist():
                    head = b"" if value is None else f"{value}:".encode()
                    digests = b"".join([md5(head + b, usedforsecurity=False).digest() for b in places])
                    padded[:, :16] = np.frombuffer(digests, np.uint8).reshape(blocks, 16)
                    letters = np.frombuffer(b64encode(padded.tobytes()), np.uint8).reshape(blocks, 24)[:, :_PER_DIGEST]
                    texts.append(letters.tobytes().translate(spaces, b"/")[:characters].decode())
                yield pa.array(texts, pa.string())

    return drawn(key.cast("string"))


def long_conversations(ids: DataFrame, key: str, seed: int = 0, characters: int = TURN_CHARACTERS) -> DataFrame:
    """A user and an assistant turn of random text for each id."""
    turn = F.explode(F.array(F.lit("user"), F.lit("assistant")))
    return ids.select(key, turn.alias("role")).withColumn(
        "content", random_text(F.concat_ws(":", F.lit(seed), F.col(key), F.col("role")), characters)
    )
