import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

CLASH = "doc_id long, text string, lang string, source string, n_chars long, component_id string, fp string, th int, removed_lines int, score string, shard string, ids int, part string, start string, base string, held_out int, row int, node string, key string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names operators use inside."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["x" if "string" in c else 7 for c in CLASH.split(", ")[5:]]) for i, t in rows], CLASH)

    return build


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as tables of one folder and gives its path."""

    def build(**tables):
        folder = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, a very long text, ties and characters of all kinds."""
    return [(3, "A b c d e."), (3, "A b c d e."), (1, None), (2, ""), (None, "nobody's text here"), (None, None), (4, " \n\t \n"), (5, "same line\nsame line\nother"),
            (6, "ä ö ü \U0001f600 日本語のテキスト x y\r\nz"), (7, "a b c d e."), (8, "word " * 30_000), (9, "x" * 50_000), (10, "same line\nother"), (0, "<|endoftext|> 1.2.3.4")]
