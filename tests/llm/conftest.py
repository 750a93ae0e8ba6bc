import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EDGES = [
    (7, None, "en", "a", None),
    (3, "", "en", None, 0),
    (None, "an id that is null", None, "a", 18),
    (5, "the same text twice", "en", "a", 19),
    (5, "the same text twice", "en", "a", 19),
    (9, "word " * 30_000 + "end", "en", "b", 150_003),
    (11, " \n\t \x0b\x0c\r\n ", "en", "b", 9),
    (12, "ünï çödé ΑΣ ΣΑΣ İstanbul é ﬁ ½ Ⅷ <|endoftext|> don't WE'LL _x_ a_b 12,5 \x1c x\xa0y z \x85 日本語😀😀", "xx", "b", 90),
]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) or full ones to a documents table with a clashing further column or two."""

    def make(rows, extra=()):
        full = [r if len(r) == 5 else (*r, "en", "a", len(r[1] or "")) for r in rows]
        schema = SCHEMA + "".join(f", {name} string" for name in extra)
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in full], schema)

    return make


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES, extra=("size", "shard", "n", "_n", "length", "vslot", "ids", "_g"))
