"""op6 beyond the fixed patterns: a plain version of the scored runs, rates by length, what is left beside spans."""

import random
import re

from tests.llm import brute

from rasterlab.llm import queries as Q
from rasterlab.llm import secret_scan as ss

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
LEAST, RATIO = 10, 12.0


def plain_markov(text, ratios):
    """Spans of scored runs outside the fixed patterns' spans."""
    left = list(text or "")
    for start, _, end in brute.secrets(text):
        left[start:end] = " " * (end - start)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST, "".join(left)):
        codes = [0, *(min(ord(c), 127) for c in m[0])]
        if sum(ratios[a * 128 + b] for a, b in zip(codes, codes[1:])) >= RATIO:
            out.append((m.start(), m.end()))
    return out


def test_scored_runs_of_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratios = ss.train_markov(docs, "text", "doc_id", 20_000).first()["ratios"]
    got = {r.doc_id: r.spans for r in Q.QUERIES["op6_markov_secrets"](spark, sf_dir).collect()}
    for r in docs.collect():
        mine = [tuple(map(int, s.split(":")[1:])) for s in got[r.doc_id].split(",") if s.startswith("markov")]
        assert mine == plain_markov(r.text, ratios), r.doc_id


def test_rates_by_length(spark):
    """Short random strings are found by their ratio; words, identifiers, dates and numbers are left alone."""
    rng = random.Random(8)
    prose = [w for w in brute.WORD.findall(open(ss.__file__).read()) if re.fullmatch("[A-Za-z][A-Za-z_-]{3,}", w)]
    make = lambda n: "".join(rng.choices(ALPHABET, k=n))
    texts = [(k, " ".join(rng.choices(prose, k=60)) + f" token={make(32)} on 2024-03-{k % 28 + 1:02d} at 12345{k}678") for k in range(300)]
    planted = {}
    for n in (10, 12, 14, 16, 19):
        for k in range(60):
            planted[n * 1000 + k] = f"see {make(n)} here"
    calm = ["international_telephone_numbers", "2024-01-01", "1234567890", "counterrevolutionary", "left/right/upper", "base64-encoded", "0031-20-5551234"]
    rows = [*texts, *planted.items(), *[(9_000_000 + k, f"the {w} again") for k, w in enumerate(calm)]]
    found = {r.doc_id: [s for s in r.spans if s["kind"] == "markov"] for r in ss.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rate = {n: sum(bool(found[n * 1000 + k]) for k in range(60)) / 60 for n in (10, 12, 14, 16, 19)}
    assert rate[10] >= 0.4 and rate[12] >= 0.6 and rate[16] >= 0.75 and rate[19] >= 0.85, rate
    assert not [w for k, w in enumerate(calm) if found[9_000_000 + k]]
    assert not any(found[k] for k, _ in texts)


def test_what_is_left_beside_a_span(spark):
    rng = random.Random(3)
    tail = "Z" + "".join(rng.choices(ALPHABET, k=28)) + "Q"
    rows = [(k, f"token={''.join(rng.choices(ALPHABET, k=32))} some ordinary words here") for k in range(100)]
    rows += [(500, "x " + "0123456789abcdef" * 3 + tail + " y"), (501, tail + "0123456789abcdef" * 3), (502, f"{tail} password=hunter22;{tail}")]
    out = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in ss.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[500] == [("hex", 2, 50), ("markov", 50, 80)]
    assert out[501] == [("markov", 0, 30), ("hex", 30, 78)]
    assert [k for k, _, _ in out[502]] == ["markov", "assign", "markov"]
