from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"


def table(name: str, columns: str = "*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, LONG, "x"), (5, "one", "x"), (5, "one", "x"), (6, LONG, "y"), (None, "one two", "z"), (7, "Ünï \u2028 çödé 東京 </s> [INST] \x00", "q")]
#: documents with cases of all kinds and columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, id string, fp int, doc string, term string"


def odd(spark):
    return spark.createDataFrame([(i, t, s, 1, s, s) for i, t, s in ODD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
