"""Table functions: rows of a partition in, other rows out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf
class WordWindows:
    """Overlapping windows of words over all rows of a conversation, in order of its turns.

    word_windows(TABLE(t), size => 50, overlap => 10): t has conv_id, turn and
    text. A window starts every size - overlap words; the last is the first that
    reaches the end. Rows are taken one by one, so no more than a window's words
    are held. Conversations without words have no window.
    """

    def __init__(self) -> None:
        self.words: list[tuple[int, str]] = []
        self.key, self.chunk, self.fresh = None, 0, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument must be a table")
        missing = {"conv_id", "turn", "text"} - set(rows.dataType.fieldNames())
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        if size.value is None or overlap.value is None or not 0 <= overlap.value < size.value:
            raise ValueError("size and overlap must be constants, the overlap smaller")
        schema = StructType().add("conv_id", LongType()).add("chunk", IntegerType()).add("first_turn", LongType()).add("n_words", IntegerType()).add("words", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("conv_id")], orderBy=[OrderingColumn("turn")])

    def window(self, size: int) -> tuple:
        part = self.words[:size]
        return self.key, self.chunk, part[0][0], len(part), " ".join(w for _, w in part)

    def eval(self, rows: Row, size: int, overlap: int) -> Iterator[tuple]:
        self.key, self.size = rows["conv_id"], size
        for w in (rows["text"] or "").split():
            self.words.append((rows["turn"], w))
            self.fresh += 1
            if len(self.words) == size:
                yield self.window(size)
                self.words = self.words[size - overlap :]
                self.chunk, self.fresh = self.chunk + 1, 0

    def terminate(self) -> Iterator[tuple]:
        if self.words and self.fresh:
            yield self.window(self.size)


def register(spark: SparkSession) -> None:
    spark.udtf.register("word_windows", WordWindows)
