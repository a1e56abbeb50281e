import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from invented import LANGS, sentence  # noqa: E402

@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, repeats, and awkward cases."""
    rnd = random.Random(5)
    out = []
    for k in range(90):
        lang = rnd.choice(list(LANGS))
        text = "\n".join(sentence(rnd, lang, rnd.randint(5, 30)) for _ in range(rnd.randint(1, 12)))
        out.append([k * 3, text, lang, f"s{min(k % 7, 3)}"])
    passage = sentence(rnd, "en", 60)
    for k in (3, 11, 40, 70):
        out[k][1] += "\n" + passage + "\n" + out[k][1][:80]
    for k, of in ((20, 2), (21, 2), (60, 5), (61, 5), (62, 5)):
        out[k][1] = out[of][1]
    for k, of in ((30, 7), (31, 7)):
        out[k][1] = out[of][1].replace(" the ", "  a  ", 1) + " end"
    out[50][1] = "ab " * 400
    out[51][1] = "x" * 3000
    out[52][1] = "".join(rnd.choice("abcé!'") for _ in range(6000))
    out[53][1] = (out[1][1] + " ") * 60
    out += [[500, None, "en", "s1"], [501, "", None, None], [502, "  \n\t ", "fr", None], [503, "12 34 !?", "de", "s9"], [504, "one", "en", "s2"], [504, "one", "en", "s2"], [505, "a\x0bb\x0cc d\x1ce", "en", "s0"], [None, out[2][1], "en", "s0"], [None, None, None, None], [506, "日本語 テキスト 😀😀 é́", "en", "s0"]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
