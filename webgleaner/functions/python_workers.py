"""Functions that run in Python workers, shipped by value so that executors need no install."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def gunzip_series(bodies: pd.Series) -> pd.Series:
    """Gunzip each body (all members); None when the data is not gzip."""

    def unpack(data):
        if data is None:
            return None
        out, rest = [], bytes(data)
        try:
            while rest:
                stream = zlib.decompressobj(wbits=31)
                out.append(stream.decompress(rest) + stream.flush())
                if not stream.eof:
                    return None
                rest = stream.unused_data.lstrip(b"\x00")
        except zlib.error:
            return None
        return b"".join(out)

    return bodies.map(unpack)


def call_model(fn):
    """Partition function that adds the model's answers to batches of prompt rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for raw in fn(batch["messages"].tolist()):
                failed = isinstance(raw, Exception)
                answers.append(None if failed else raw)
                errors.append(str(raw) if failed else None)
            yield batch.assign(raw=pd.Series(answers, dtype=object, index=batch.index),
                               error=pd.Series(errors, dtype=object, index=batch.index))

    return run
