"""The seam to judge and probe models: one client a task, calls in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Takes prompts and gives, for each, a reply, None, or the error that stood in its way.
Client = Callable[[list[str]], list[str | None | Exception]]


def asked(df: DataFrame, prompt: str, connect: Callable[[], Client], batch: int = 64) -> DataFrame:
    """df with reply and error: what a model says to the text in prompt.

    connect makes a client once in each task; prompts that are equal within a batch are sent
    once. A call that raises leaves its prompts without reply and with the name of the error,
    and the next batch goes on. A null prompt is not sent.
    """
    fields = [f for f in df.schema.fields if f.name not in ("reply", "error")]
    names = [f.name for f in fields]

    def ask(client: Client, texts: list[str]) -> dict[str, str | None | Exception]:
        try:
            return dict(zip(texts, client(texts), strict=True))
        except Exception as e:
            return dict.fromkeys(texts, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = connect()
        for big in batches:
            for at in range(0, big.num_rows, batch):
                part = big.slice(at, batch)
                texts = part.column(names.index(prompt)).to_pylist()
                said = ask(client, list(dict.fromkeys(t for t in texts if t is not None)))
                got = [said.get(t) for t in texts]
                reply = [None if isinstance(x, Exception) else x for x in got]
                error = [type(x).__name__ if isinstance(x, Exception) else None for x in got]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(reply, pa.string()), pa.array(error, pa.string())], [*names, "reply", "error"])

    return df.select(*names).mapInArrow(run, StructType(fields).add("reply", "string").add("error", "string"))
