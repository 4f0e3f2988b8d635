"""Batched text-to-text models over a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

TextModel = Callable[[list[str]], list[str]]


def map_text_batches(
    df: DataFrame,
    text: str,
    model_factory: Callable[[], TextModel],
    batch_size: int = 32,
    output: str = "translated",
    parallelism: int | None = None,
) -> DataFrame:
    """Adds ``output``: the model's answer to each text, asked ``batch_size`` texts at a time.

    The model is built once per task and rows stream through it in Arrow batches, whose other
    columns are passed on as they are. Small files make few tasks, so ``parallelism`` spreads rows
    out before a slow model. A null text stays null and is not shown to the model.
    """
    schema = StructType([*df.schema.fields, StructField(output, StringType())])

    place = df.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_factory()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            answers: list[str | None] = [None] * len(texts)
            for at in range(0, len(asked), batch_size):
                part = asked[at:at + batch_size]
                for i, answer in zip(part, model([texts[i] for i in part]), strict=True):
                    answers[i] = answer
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=schema.names)

    rows = df.repartition(parallelism) if parallelism else df
    return rows.mapInArrow(apply, schema)


def glossary_model(terms: dict[str, str]) -> Callable[[], TextModel]:
    """Stand-in for a translation model: replaces terms, in the order given."""

    def factory() -> TextModel:
        def model(texts: list[str]) -> list[str]:
            out = []
            for text in texts:
                for term, replacement in terms.items():
                    text = text.replace(term, replacement)
                out.append(text)
            return out

        return model

    return factory
