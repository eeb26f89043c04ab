"""Model and floors of language ID come from all labelled rows, whatever their number."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.language_id import floors, learned

COLUMNS = "doc_id long, text string, lang string"


def text(i, words):
    return " ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] for k in range(12))


ONE, TWO, NEW = ["alpha", "beta", "gamma", "delta", "omega"], ["uno", "dos", "tres", "cuatro", "cinco"], ["zwy", "xqj", "vwk", "jzq", "kxw"]


def test_every_row_teaches(spark):
    """Words of a hundred rows in 2,000 of a language are known, though no row among the first of the order that landmarks are chosen in has them."""
    late = [r["id"] for r in spark.range(2000, 4000).orderBy(F.xxhash64("id"), "id").collect()][-100:]
    rows = [(i, text(i, ONE), "a") for i in range(2000)] + [(i, text(i, NEW if i in late else TWO), "b") for i in range(2000, 4000)]
    model = learned(spark.createDataFrame(rows, COLUMNS).repartition(3))
    told = model.scores([text(3, ONE), text(3, TWO), text(3, NEW)])[0]
    assert [model.languages[int(k)] for k in told.argmax(axis=1)] == ["a", "b", "b"] and told[2].max() > 0.2


def test_floors_of_every_row(spark):
    """Half of the median of all texts of a size: most rows of a language decide, not its first 250."""
    fitted = learned(spark.createDataFrame([(i, text(i, ONE if i % 2 else TWO), "a" if i % 2 else "b") for i in range(400)], COLUMNS))
    mixed = " ".join(f"{a} {b}" for a, b in zip(ONE, NEW, strict=True))
    rows = [(i, text(i, ONE), "a") for i in range(300)] + [(i, mixed, "a") for i in range(300, 1000)]
    whole = floors(fitted, spark.createDataFrame(rows, COLUMNS).repartition(3))
    scores = lambda t: fitted.scores([t])[0].max()
    size = int(np.log2(len({mixed[i : i + n] for n in (1, 2, 3) for i in range(len(mixed))})))
    assert abs(whole[size] - scores(mixed) / 2) < 0.05
    assert (floors(fitted, spark.createDataFrame([], COLUMNS)) == 0).all()
