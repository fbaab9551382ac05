"""Operators in SQL: table functions over columns and tables, scalar functions, and operators' results as views.

    register(spark)
    SELECT wa, wb, count(*) FROM documents, LATERAL sentences_of(text) s, LATERAL word_pairs(s.words, 2) GROUP BY ALL
    SELECT * FROM sentence_trees(TABLE(SELECT sent_id, words, wa, wb, mi FROM …) PARTITION BY sent_id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgraph.operators import components, mi, pairs, parse, similarity
from lexgraph.session import ensure_importable, write_table

#: Table and scalar functions that Spark itself plans, so they stay in the JVM.
FUNCTIONS = [
    r"""sentences_of(t STRING COMMENT 'a text') RETURNS TABLE(no INT, words ARRAY<STRING>)
RETURN SELECT no, words FROM (SELECT no, array_remove(split(lower(regexp_replace(s, '[^A-Za-z\']+', ' ')), ' '), '') AS words FROM posexplode(split(t, '[.!?\n]')) AS x(no, s)) WHERE size(words) >= 2""",
    """word_pairs(w ARRAY<STRING> COMMENT 'words in order', far INT COMMENT 'places apart at most') RETURNS TABLE(wa STRING, wb STRING)
RETURN SELECT p.wa, p.wb FROM explode(flatten(transform(sequence(1, far), d -> transform(filter(sequence(0, size(w)), i -> i + d < size(w)), i -> named_struct('wa', least(w[i], w[i + d]), 'wb', greatest(w[i], w[i + d])))))) AS x(p) WHERE p.wa <> p.wb""",
    f"""pair_value(c BIGINT, l BIGINT, r BIGINT, total BIGINT) RETURNS DOUBLE
RETURN CASE WHEN c < 1 THEN 0D ELSE log2(c) + log2(greatest(total, {mi.EPS}D)) - log2(greatest(l, {mi.EPS}D)) - log2(greatest(r, {mi.EPS}D)) END""",
    "grammar_cost(c BIGINT, top BIGINT) RETURNS DOUBLE RETURN CASE WHEN c < 1 THEN 99D ELSE least(greatest(-0.5D * log2(greatest(c / greatest(top, 1), 1e-20D)) + 0.1D, 0.1D), 10D) END",
]
#: Operators that take whole tables, and what they are called as views.
VIEWS = {
    "pair_counts": lambda sents, window=6, self_pairs=False: pairs.pair_counts(sents, window, self_pairs),
    "values": lambda counts: mi.mi_full(counts),
    "trees": lambda sents, values: parse.word_trees(sents, values),
    "sections": lambda edges: parse.sections(edges),
    "cosines": lambda sections, threshold=0.0: similarity.cosine_above(sections, threshold),
    "forest": lambda edges: components.spanning_forest(edges),
    "components": lambda nodes, edges: components.components_of(nodes, edges),
}


def _tree_function():
    """The table function sentence_trees: rows of a sentence (sent_id, words, wa, wb, mi), one for each pair with a value, and nulls where there is none."""
    from pyspark.sql.functions import OrderingColumn, PartitioningColumn, udtf
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
    from pyspark.sql.udtf import AnalyzeResult

    need = ("sent_id", "words", "wa", "wb", "mi")

    @udtf
    class SentenceTrees:
        @staticmethod
        def analyze(table) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("sentence_trees needs a TABLE argument")
            found = {f.name: f.dataType for f in table.dataType.fields}
            if missing := [c for c in need if c not in found]:
                raise ValueError(f"sentence_trees needs the columns {', '.join(need)}; missing: {', '.join(missing)}")
            if not isinstance(found["words"], ArrayType):
                raise ValueError("words must be an array")
            word = found["words"].elementType
            schema = StructType().add("sent_id", found["sent_id"]).add("p1", IntegerType()).add("p2", IntegerType()).add("w1", word).add("w2", word).add("weight", DoubleType())
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("sent_id")], orderBy=[OrderingColumn("wa"), OrderingColumn("wb")])

        def __init__(self):
            self.row, self.pairs = None, {}

        def eval(self, row):
            self.row = row
            if row["wa"] is not None and row["mi"] is not None:
                value = float(row["mi"])
                self.pairs[row["wa"], row["wb"]] = (value, round(value, 9))

        def terminate(self):
            if self.row is None or self.row["words"] is None:
                return
            words = list(self.row["words"])
            for p1, p2, value in parse.tree(words, None, [(a, b, *v) for (a, b), v in self.pairs.items()], []):
                yield self.row["sent_id"], p1, p2, words[p1], words[p2], value

    return SentenceTrees


def register(spark: SparkSession) -> None:
    """Give the session the functions sentences_of, word_pairs, pair_value, grammar_cost and sentence_trees."""
    ensure_importable(spark)
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udtf.register("sentence_trees", _tree_function())


def view(spark: SparkSession, name: str, operator: str, *tables: str, **settings) -> DataFrame:
    """Run an operator of VIEWS on tables or queries named in SQL, and give its written result the name of a view."""
    given = [write_table(spark.sql(t), "given") if t.lstrip().upper().startswith(("SELECT", "WITH", "FROM")) else spark.table(t) for t in tables]
    found = write_table(VIEWS[operator](*given, **settings), name)
    found.createOrReplaceTempView(name)
    return found
