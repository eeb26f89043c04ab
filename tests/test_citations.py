"""Citations and the entries they name, against a plain version with the same rules."""

import unicodedata

import pytest
import regex

from quillspark.functions import fixed
from quillspark.operators import citations as ct

BLOCK = "paper_id string, block_order long, kind string, section string, text string"


def words(t):
    return regex.findall(r"[\p{L}\p{M}'’-]+", unicodedata.normalize("NFKC", t).lower())


def by_hand(cite, blocks):
    m = regex.match(r"([\p{L}'’-]+)[\s\S]*?\b(\d{4})([a-z]?)\b", cite)
    if not m:
        return None
    refs = [b for b in blocks if b[2] == "para" and regex.search("reference|bibliograph|参考文献", b[3] or "", regex.I)]
    head = next((b for b in blocks if b[2] == "heading" and regex.search("reference|bibliograph|参考文献", b[4], regex.I)), None)
    pool = refs or [b for b in blocks if head and b[2] == "para" and b[1] > head[1]]
    last = lambda n: (words(n) or [None])[-1]
    found = []
    for b in pool:
        text = regex.sub(r"^\s*(?:\[\d+\]|\d+[.)])\s*", "", b[4])
        name = words(regex.split(r"[,，;]|\s+(?:and|&)\s+", regex.split(fixed.AUTHORS_END, text)[0])[0])
        if name and name[-1] == " ".join(words(m[1])) and len(name) <= 6 and m[2] + m[3] in ["".join(y) for y in regex.findall(r"\b(\d{4})([a-z]?)\b", text)]:
            found.append(b)
    if len(found) == 1:
        return found[0][1]
    second, out = regex.search(r"\s+(?:and|&)\s+([\p{L}'’-]+)", cite), []
    for b in found:
        authors = [a for a in (last(regex.sub(r"^\s*and\s+", "", n)) for n in regex.split(r"[,，;]|\s+(?:and|&)\s+", regex.split(fixed.AUTHORS_END, b[4])[0])) if a]
        if (len(authors) == 2 and authors[1] == " ".join(words(second[1]))) if second else (regex.search(r"\bet al\.", cite) and len(authors) >= 3):
            out.append(b)
    return out[0][1] if len(out) == 1 else None


ENTRIES = [
    "[1] Lewis, P., Perez, E. and Piktus, A. Retrieval for tasks. 2020.", "2) Lewis and Karpukhin. Dense passages. 2020", "Lewis. Alone. 2020a.", "J. Müller, B. Ödmann. Über etwas, 2019. Again 2021b.",
    "Müller, K. Decomposed. 2021b.", "Ｗang, X., and Li, Y. Wide letters. 2018", "Devlin, J., Chang, M., Lee, K. Deep. NAACL 2019", "Devlin, J. and Toutanova, K. Deeper. 2019", "Devlin, J. and Toutanova, K. Deepest. 2019",
    "A very long name of some seven words, X. Too long. 2017", "O'Brien-Smith, T. Hyphens. 2016", "1999", "",
]
TEXTS = [
    "as shown (Lewis et al., 2020; Lewis and Karpukhin 2020; Lewis 2020) and Lewis, 2020a. WMT 2014 is none.", "Müller 2019; (Müller, 2019) Müller & Ödmann 2021b, (Müller 2021b)", "Wang and Li, 2018 and Devlin et al. 2019 or Devlin and Toutanova, 2019",
    "O'Brien-Smith, 2016 (Nobody 2000) （Lewis 2020） Words, 2017", None, "", "Lewis et al., 2020 Lewis et al., 2020",
]


@pytest.fixture(scope="module")
def blocks():
    with_section = [("p", i, "para", "Intro", t) for i, t in enumerate(TEXTS)] + [("p", 50 + i, "para", "REFERENCES", t) for i, t in enumerate(ENTRIES)]
    by_heading = [("q", i, "para", None, t) for i, t in enumerate(TEXTS)] + [("q", 40, "heading", None, "7 Bibliography")] + [("q", 50 + i, "para", None, t) for i, t in enumerate(ENTRIES[::-1])]
    return with_section + by_heading + [("r", i, "para", "Intro", t) for i, t in enumerate(TEXTS)]


def test_cited(spark, blocks):
    table = spark.createDataFrame(blocks, BLOCK)
    cites = ct.citations(table.where("block_order < 40"), ["paper_id", "block_order"])
    got = sorted((r["paper_id"], r["block_order"], r["place"], r["cite"], r["entry"]) for r in ct.cited(cites, ct.entries(table)).collect())
    want = []
    for p, o, _, _, t in blocks:
        if o < 40 and t:
            for i, m in enumerate(regex.finditer(fixed.CITATION, t)):
                want.append((p, o, i, m[0], by_hand(m[0], [b for b in blocks if b[0] == p and b[4] is not None])))
    assert got == sorted(want)
    assert {e for *_, e in want} >= {50, 51, 52, 60, None}


def test_many_random_entries(spark):
    import random

    rng, names = random.Random(4), ["Lee", "Kim", "Öz", "Li-Wu", "Ray"]
    entry = lambda: f"{rng.choice(names)}, A." + rng.choice(["", f" and {rng.choice(names)}, B.", f", {rng.choice(names)}, B., {rng.choice(names)}, C."]) + f" Some title. {rng.randint(2010, 2012)}{rng.choice(['', '', 'a'])}."
    cite = lambda: rng.choice(["({0} {2})", "{0} et al., {2}", "{0} and {1}, {2}", "{0}, {2}"]).format(rng.choice(names), rng.choice(names), f"{rng.randint(2010, 2012)}{rng.choice(['', 'a'])}")
    rows = [(f"p{k}", i, "para", "Intro", " see ".join(cite() for _ in range(6))) for k in range(20) for i in range(3)] + [(f"p{k}", 50 + i, "para", "References", entry()) for k in range(20) for i in range(12)]
    table = spark.createDataFrame(rows, BLOCK)
    got = sorted((r["paper_id"], r["block_order"], r["place"], r["entry"]) for r in ct.cited(ct.citations(table.where("block_order < 40"), ["paper_id", "block_order"]), ct.entries(table)).select("paper_id", "block_order", "place", "entry").collect())
    want = [(p, o, i, by_hand(m[0], [b for b in rows if b[0] == p])) for p, o, _, _, t in rows if o < 40 for i, m in enumerate(regex.finditer(fixed.CITATION, t))]
    assert got == sorted(want) and sum(e is not None for *_, e in want) > 40
    assert ct.cited(ct.citations(table.limit(0), ["paper_id"]), ct.entries(table)).count() == 0
