"""Every operator on awkward inputs and against its plain version."""

import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components, decontaminate, licenses, linededup, neardup, packing, quality, secrets, sharding, substrings, toxicity

from . import brute, secret_values

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"w{i}" for i in range(40)]


def frame(spark, rows, schema=DOCS):
    """Rows (doc_id, text); the other columns are filled in, with nulls."""
    full = [(d, t, None, f"s{(d or 0) % 3}" if (d or 0) % 4 else None, None) for d, t in rows]
    return spark.createDataFrame(full, schema)


def prose(rng, n, vocabulary=VOCABULARY):
    return "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", "\n", ".\n", "  ")) for _ in range(n))


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, empty, null and long texts."""
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "a\nA \n a")]
    shared = prose(rng, 40)
    for d in range(6, n):
        kind = d % 6
        if kind == 0 and d > 12:
            rows.append((d, rng.choice(rows[6:])[1]))
        elif kind == 1 and d > 12:
            own = (rng.choice(rows[6:])[1] or "").split(" ")
            own[rng.randrange(len(own))] = "changed"
            rows.append((d, " ".join(own)))
        elif kind == 2:
            rows.append((d, prose(rng, 15) + shared + prose(rng, 15)))
        else:
            rows.append((d, prose(rng, rng.randint(1, 120), [f"v{rng.randrange(4000)}" for _ in range(60)]) + "\nCommon LINE \n"))
    rows.append((n, prose(rng, 9000)))
    rng.shuffle(rows)
    return rows


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


EMPTY = []


CLASHING = (
    "a", "b", "band", "bands", "bucket", "bytes", "cell", "component", "d1", "distance", "failed", "first_id", "fp", "grp", "host", "hub", "item_id", "key", "kept",
    "labelled_id", "length", "n", "n_docs", "n_lines", "n_words", "node", "of_text", "own", "piece", "range", "rep", "repeated", "rid", "score", "segment", "shard",
    "size", "slot", "start", "suspects", "t", "text_crc32", "text_id", "tkey", "toxic", "w",
)
APPLIED = {
    "lines": lambda s, d: linededup.dedup_lines(d, 2),
    "lines_joined": lambda s, d: linededup.dedup_lines(d, 2, max_broadcast_keys=0),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "quality": lambda s, d: quality.host_quality(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit(d, s.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int"), F.lit(True))),
    "substrings": lambda s, d: substrings.dedup_substrings(d),
    "substrings_joined": lambda s, d: substrings.dedup_substrings(d, max_broadcast_keys=0),
    "edits": lambda s, d: decontaminate.match_items(d, s.createDataFrame([(1, "one", "x")], "item_id bigint, text string, doc_id string")),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "sharding": lambda s, d: sharding.shard(d, 4).select("doc_id", "size", "text_crc32"),
    "packing": lambda s, d: packing.pack(d, __import__("public_tokenizers").path("word_bpe_49k.json"), 256).select("doc_id", "piece", "start", "length", "ids_crc32"),
}


@pytest.mark.parametrize("name", sorted(APPLIED))
def test_extra_columns_change_nothing(spark, name):
    df = frame(spark, corpus(20, 40)).coalesce(2)
    more = df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    want, mine = APPLIED[name](spark, df), APPLIED[name](spark, more)
    assert mine.columns == want.columns
    assert got(mine, *mine.columns) == got(want, *want.columns)


# --- 1 ------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [1000, 0])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_lines(spark, bound, min_docs):
    rows = [*corpus(), (7, "twice\nCommon line"), (7, "twice\nCommon line"), (None, "twice")]
    df = linededup.dedup_lines(frame(spark, rows), min_docs, keep_first=False, filter_words=1 << 12, max_broadcast_keys=bound)
    mine = got(df.withColumn("h", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "h")
    assert mine == sorted(brute.lines(rows, min_docs), key=repr)
    assert any(r[2] for r in mine)


def test_first_occurrence_stays(spark):
    rows = [(3, "x\ny"), (1, "Y \nz\ny"), (2, "y"), (None, "q")]
    out = dict(got(linededup.dedup_lines(frame(spark, rows), 2), "doc_id", "text"))
    assert out == {1: "Y \nz", 2: "", 3: "x", None: "q"}


def test_a_full_filter_changes_nothing(spark):
    rows = corpus(2)
    df = linededup.dedup_lines(frame(spark, rows), 3, keep_first=False, filter_words=16)
    assert got(df, "doc_id", "n_lines", "n_dropped") == sorted((r[:3] for r in brute.lines(rows, 3)), key=repr)


def test_filters_merge_in_a_tree(spark, monkeypatch):
    """Two pairs at a time, segment by segment, give what one task would."""
    rows = corpus(22)
    monkeypatch.setattr(linededup, "FAN_IN", 2)
    monkeypatch.setattr(linededup, "SEGMENT_WORDS", 1 << 10)
    docs = frame(spark, rows).repartition(7)
    merged = linededup.twice_filter(docs, "text", 1, 1 << 12)
    monkeypatch.setattr(linededup, "FAN_IN", 100)
    assert (merged == linededup.twice_filter(docs, "text", 1, 1 << 12)).all()
    seen = Counter(k for _, t in rows for k in {x.strip(brute.SPACES) for x in brute.lower(t or "").split("\n")} if k)
    found = linededup.Filter(merged).has(linededup._hashes([k.encode() for k in seen]))
    assert all(f for f, n in zip(found, seen.values(), strict=True) if n > 1)
    assert found.mean() < 0.9
    assert linededup.filter_size(frame(spark, rows), "text") == linededup.MIN_FILTER_WORDS


def test_filters_follow_the_lines(spark):
    docs = spark.range(60).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: F.concat("id", F.lit("x"), i)), "\n").alias("text"))
    assert linededup.filter_size(docs, "text") == 1 << 18  # 600,000 lines at 16 bits
    assert linededup.filter_size(docs.limit(0), "text") == linededup.MIN_FILTER_WORDS


def test_lines_of_nothing_and_carried_columns(spark):
    assert linededup.dedup_lines(frame(spark, EMPTY), 2).count() == 0
    df = frame(spark, [(1, "a")]).withColumn("n_lines", F.lit("clash")).withColumn("key", F.lit(0))
    assert linededup.dedup_lines(df, 2, carry=("lang", "source")).columns == ["doc_id", "text", "lang", "source", "n_lines", "n_dropped"]


# --- 2 ------------------------------------------------------------------------


def test_secret_patterns_against_a_hand_scan():
    rng = random.Random(5)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "APIKEY", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "a1b2c3d4e5f6a7b8", "ſecret", "é", "x", "\n", "+/_.=-", "toKen"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == brute.secrets(text), text


def test_guess_costs():
    ranks = {"password": 1, "monkey": 20, "river": 300}
    cost = lambda s: secrets.guess_cost(s, ranks)
    assert cost("") == 0
    assert cost("password") < cost("p4ssword") < cost("xq9vzk2w")
    assert cost("aaaaaaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 6
    assert cost("20240131") < cost("83920174")
    assert cost("monkeyriver") < cost("mqnkzyrvvxr")
    assert cost("f3ef4d6b2755a36d7d") > secrets.MIN_GUESSES > cost("password2024")
    assert cost("abcabcabcabc") < cost("abcxyzkdwqpr") and cost("z8z8z8z8z8z8") < 4  # copies of a block
    began = time.process_time()
    assert cost("".join(random.Random(1).choices("qz8k7x", k=100_000))) > 1000 > cost("z8" * 50_000)
    assert time.process_time() - began < 40  # linear in the value


def test_guess_cost_is_the_least_over_all_segmentations():
    """All five kinds, by trying every segment as every kind."""
    ranks = {"abc": 5, "bcd": 2, "cde": 1, "abcde": 50, "pass": 7, "az": 3, "river": 300}
    rng = random.Random(24)
    bits = ["abc", "bcd", "ab", "qwe", "asd", "zx", "1", "9", "2024", "19", "31-1-24", "20240131", "310124", "1/2/1999", "p4ss", "Pass", "@", "İ", "_", "-", "xx", "é", "ABC", "river", "7"]
    values = ["", "a", "aaaa", "abcabcabcabc", "ababababab", "xyzxyz1xyzxyz1", "31122024", "20241231x", "1999-1-2", "İpass", "12/31/99qwerty", "qwertyqwerty", "ééééé"]
    for _ in range(250):
        own = "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))
        values.append(own * rng.choice((1, 1, 1, 2, 3)) if len(own) < 7 else own)
    for value in values:
        assert secrets.guess_cost(value, ranks) == pytest.approx(brute.guess_cost(value, ranks, secrets.NEAR), abs=1e-9), value


def test_placeholders_and_code_are_no_secrets():
    ranks = secrets.word_ranks(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for text in ("api_key = your_api_key_here", "API_KEY=process.env.API_KEY", 'password: "changeme"', "secret = os.environ.get(SECRET)", "token: xxxxxxxxxxxxxxxx", "pwd=abcabcabcabc", "password=ababababababab", "password = 31.12.2024", "password=qwertyuiop12345", "token = example-token-1", 'password="password123"', "secret: <your-secret>", "auth=basic_auth"):
        assert not secrets.guess_spans(text, ranks), text
    for text in ("api_key = q8Zr5vKw1tYx", "pwd=fkqzvbnwtrpl", "secret: 7f3k-92xq-zz81"):
        assert len(secrets.guess_spans(text, ranks)) == 1, text


def test_a_very_long_document_of_secrets(spark):
    text = "pwd=q8Zr5vKw1tYx some words in between\n" * 20_000
    row = secrets.scan_secrets(frame(spark, [(1, text), (2, "x")])).where("doc_id = 1").first()
    assert len(row["found"]) == 20_000 and row["found"][-1]["end"] == len(text) - len(" some words in between\n")


def test_secret_spans(spark):
    rows = [(1, "é pwd: 'k9$Xq2!mZ7pL' x"), (2, None), (3, "url postgres://me:q8Zr5vKw1tYx@host/db"), (4, "password: password"), (4, "Authorization: Bearer q8Zr5vKw1tYxPq")]
    found = {(r["doc_id"], s["kind"], s["value"]) for r in secrets.scan_secrets(frame(spark, rows)).collect() for s in r["found"]}
    assert found == {
        (1, "guess", "k9$Xq2!mZ7pL"), (3, "guess", "q8Zr5vKw1tYx"), (4, "assign", "password: password"), (4, "guess", "q8Zr5vKw1tYxPq"),
    }
    assert secrets.scan_secrets(frame(spark, EMPTY)).count() == 0


def test_secret_values_are_scored_whole():
    long = "s" * 40, "u" * 90
    for text, value in {
        'passphrase: "correct horse zvqk staple" x': "correct horse zvqk staple",
        "pwd=q8Zr5;vKw1tYxPq next": "q8Zr5;vKw1tYxPq",
        "password = ab,Q8zr5vKw1tYxPq, and": "ab,Q8zr5vKw1tYxPq",
        "password=q8<Zr5>\"vKw1tYx'Pq\n": "q8<Zr5>\"vKw1tYx'Pq",
        'password="q8Zr5vKw1tYxPq\nnext" line': "q8Zr5vKw1tYxPq",
        "redis://:q8Zr5vKw1tYx@host": "q8Zr5vKw1tYx",
        f"{long[0]}://{long[1]}:q8Zr5vKw1tYx@host": "q8Zr5vKw1tYx",
    }.items():
        assert [text[s:e] for s, _, e in secrets.guess_spans(text, {})] == [value], text
    both = "password=q8Zr5vKw1tYx;token=Pq7Zr5vKw1tYx"
    assert [both[s:e] for s, _, e in secrets.guess_spans(both, {})] == ["q8Zr5vKw1tYx", "Pq7Zr5vKw1tYx"]
    assert not secrets.guess_spans('password="abc",user="bob smith junior"', {})
    for unit in ("://a:", "aa://", "pwd=;", 'pwd="', "token=',;", "a" * 50 + ":"):
        began = time.process_time()
        secrets.guess_spans(unit * (400_000 // len(unit)), {})
        assert time.process_time() - began < 30


# --- 3 ------------------------------------------------------------------------


def test_license_bands_and_containment(spark):
    rng = random.Random(2)
    mit = licenses.TEMPLATES["MIT"][1]
    changed = mit.split()
    changed[5] = "nobody"
    rows = [(0, None), (1, ""), (2, prose(rng, 300)), (3, f"{prose(rng, 77)} {mit.upper()} {prose(rng, 40)}"), (4, f"{prose(rng, 5000)}\n* {mit}"), (5, " ".join(changed)), (6, mit[: len(mit) // 2]), (7, "x\nReleased under the MIT License.\ny"), (7, "Released under the mit license")]
    out = got(licenses.scan_licenses(frame(spark, rows)), "doc_id", "license", "containment")
    assert [r[:2] for r in out] == [(3, "MIT"), (4, "MIT"), (5, "MIT"), (7, "MIT"), (7, "MIT")]
    assert licenses.scan_licenses(frame(spark, EMPTY)).count() == 0


def test_license_templates_in_blocks(spark):
    """From a table, in several passes: the same rows, settled over all of them."""
    rng = random.Random(25)
    texts = [(n, t) for n, own in licenses.TEMPLATES.items() for t in own if len(t) < 2000]
    rows = [(d, f"{prose(rng, 9)} {rng.choice(texts)[1]} {prose(rng, 30)} {rng.choice(texts)[1]}") for d in range(40)] + [(41, None), (42, "")]
    rows += [rows[3]] * 3
    table = spark.createDataFrame([*texts, ("empty", ""), ("null", None)], "license string, text string")
    columns = "doc_id", "license", "start_word", "end_word", "containment"
    want = got(licenses.scan_licenses(frame(spark, rows), table), *columns)
    assert got(licenses.scan_licenses(frame(spark, rows), table, max_templates=25), *columns) == want
    assert len(want) >= 80 and licenses.scan_licenses(frame(spark, rows), table.limit(0)).count() == 0


def test_commented_licenses_are_found():
    known = licenses.Templates([(n, t.encode()) for n, texts in licenses.TEMPLATES.items() for t in texts])
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"):
        words = licenses.TEMPLATES[name][1].split()
        for leader in ("# ", "-- ", "% ", "REM ", "dnl ", "// ", " * ", "; ", "!! ", "> ", "\t#  ", "- "):
            text = "\n".join(leader + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))
            found = known.matches(licenses.word_codes([f"code before\n{text}\nand after".encode()])[0])
            assert [known.names[m[0]] for m in found] == [name], (name, leader)


def test_license_containment_against_plain_sets():
    """Shingles as tuples of words, in the best window of the whole text."""
    import re

    def plain(text):
        text = re.sub("--+|(?m:^[ \t]*(?:-|(?i:rem|dnl))(?=[ \t\r\n]))", " ", text)
        own = [w for w in re.split(r"""[\x20\x09-\x0D.,;:!?"'()\[\]{}*_`<>/#%|=~^\\]+""", brute.lower(text)) if w]
        return [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))]

    rng = random.Random(26)
    known = licenses.Templates([(n, t.encode()) for n, texts in licenses.TEMPLATES.items() for t in texts])
    all_texts = [t for texts in licenses.TEMPLATES.values() for t in texts]
    assert len(all_texts) == len(known.names)
    for _ in range(150):
        i = rng.randrange(len(all_texts))
        own = all_texts[i].split()
        for _ in range(rng.randrange(1 + len(own) // 12)):
            own[rng.randrange(len(own))] = "zzz"
        text = f"{prose(rng, 20)}\n{' '.join(own)}\n{prose(rng, 20)}"
        want, grams = set(plain(all_texts[i])), set(plain(text))
        share = len(want & grams) / len(want)
        found = {m[0]: m[3] for m in known.found(licenses.word_codes([text.encode()])[0])}
        assert (i in found) == (100 * len(want & grams) >= 80 * len(want)) or known.shingle[i] < 5, all_texts[i][:80]
        if i in found and known.shingle[i] == 5:
            assert found[i] == pytest.approx(share)


def test_license_texts_get_their_own_name():
    known = licenses.Templates([(n, t.encode()) for n, texts in licenses.TEMPLATES.items() for t in texts])

    def names(text):
        return [known.names[m[0]] for m in known.matches(licenses.word_codes([f"some words before {text} and after".encode()])[0])]

    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert names(text) == [name], (name, text[:80])
    assert {"AGPL-3.0", "BSD-2-Clause", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "LGPL-2.1", "Unlicense"} <= licenses.TEMPLATES.keys()
    gpl, cc = licenses.TEMPLATES["GPL-2.0"][0], licenses.TEMPLATES["CC-BY-SA-4.0"][1]
    assert names(f"{gpl} x y z {cc}") == ["GPL-2.0", "CC-BY-SA-4.0"]


def test_license_windows_lose_no_passage():
    """Against containment in every stretch of the template's length."""
    rng = random.Random(8)
    templates = [("t%d" % i, " ".join(f"k{rng.randrange(300)}" for _ in range(n)).encode()) for i, n in enumerate((5, 9, 23, 70))]
    known = licenses.Templates(templates)
    for _ in range(60):
        i = rng.randrange(4)
        own = templates[i][1].decode().split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "zzz"
        text = [f"n{rng.randrange(999)}" for _ in range(rng.randrange(90))] + own + ["end"] * rng.randrange(50)
        codes, _ = licenses.word_codes([" ".join(text).encode()])
        sizes = [len(s) for s in known.sets]
        grams = set(licenses.shingle_codes(codes).tolist())
        share = sum(s in grams for s in known.sets[i].tolist()) / sizes[i]
        assert (i in {m[0] for m in known.matches(codes)}) == (100 * share >= 80)


# --- 4 ------------------------------------------------------------------------


def test_quality_features(spark):
    rng = random.Random(3)
    phrase = prose(rng, 11)
    rows = [*corpus(4), (8, phrase * 3), (8, phrase + "x " + phrase), (9, "a " * 50), (9, "# | <b> $ % &\n\n\nsame\nsame \nsame"), (None, "z\x0by\x85w é")]
    df = quality.host_quality(frame(spark, rows))
    mine = got(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert mine == sorted(((d, *brute.quality(t)) for d, t in rows), key=repr)
    assert any(r[5] for r in mine)


def test_host_verdicts(spark):
    """A bad host condemns its doubtful documents only."""
    fine, doubtful = " ".join(f"word{i}" for i in range(60)), " ".join(f"w#$%{i}" for i in range(60))
    rows = [(i, doubtful, None, "bad", 0) for i in range(90)] + [(100 + i, fine, None, "bad", 0) for i in range(5)]
    rows += [(200 + 10 * h + i, fine, None, f"good{h}", 0) for h in range(9) for i in range(10)] + [(900, doubtful, None, "good1", 0), (901, doubtful, None, None, 0), (902, "short", None, "good1", 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality.host_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(kept[i] for i in range(90)) and all(kept[100 + i] for i in range(5))
    assert kept[900] and not kept[902] and all(kept[200 + i] for i in range(90))
    assert quality.host_quality(frame(spark, EMPTY)).count() == 0


def verdicts(spark, hosts):
    """Condemned hosts of {host: (documents, failing ones)}, by Spark and by SQL."""
    import duckdb

    fine, doubtful = " ".join(f"word{i}" for i in range(60)), " ".join(f"w#$%{i}" for i in range(60))
    rows = [(h, i < k) for h, (n, k) in hosts.items() for i in range(n)]
    rows = [(d, doubtful if bad else fine, None, h, 0) for d, (h, bad) in enumerate(rows)]
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    columns = ["base_failed", "doc_id", "host_condemned", "kept"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({quality.OP4_SQL})").fetchall()
    mine = got(quality.host_quality(spark.createDataFrame(rows, DOCS)), *columns)
    assert mine == sorted(want, key=repr)
    return {rows[r[1]][3] for r in mine if r[2]}


def test_small_hosts_are_shrunk(spark):
    """One failure of one document doesn't condemn; a large bad host, named or
    null, is condemned whatever the others' size."""
    small = {f"h{i}": (1, int(i % 3 == 0)) for i in range(300)}
    assert verdicts(spark, small) == set()
    assert verdicts(spark, small | {None: (50, 50)}) == {None}
    assert verdicts(spark, small | {"bad": (80, 70), None: (1, 1)}) == {"bad"}
    assert verdicts(spark, {f"h{i}": (1 + i % 3, int(i % 10 < 3)) for i in range(90)} | {"bad": (60, 60)}) == {"bad"}
    assert verdicts(spark, {}) == verdicts(spark, {"a": (3, 0)}) == set()


def test_beta_prior_against_a_plain_fit(spark):
    rng = random.Random(21)
    for sizes, spread in (((1, 4), 0.0), ((5, 60), 3.0), ((1, 200), 0.5)):
        hosts = []
        for _ in range(400):
            n = rng.randint(*sizes)
            p = rng.betavariate(0.3 * spread, 0.7 * spread) if spread else 0.3
            hosts.append((n, sum(rng.random() < p for _ in range(n))))
        alpha, beta = quality.beta_prior(spark.createDataFrame(hosts, "n_docs bigint, n_failed bigint"))
        want = brute.beta_prior(hosts)
        assert alpha == pytest.approx(want[0], rel=1e-6) and beta == pytest.approx(want[1], rel=1e-6)
        assert abs(alpha / (alpha + beta) - 0.3) < 0.08
        assert spread / 2 < alpha + beta < spread * 2 if spread else alpha + beta > 30


def test_quality_is_native(spark):
    plan = quality.host_quality(frame(spark, corpus(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 5 ------------------------------------------------------------------------


def toxic_rows(n=600, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        bad = d % 5 == 0
        text = prose(rng, 60)
        if bad:
            text += rng.choice((" you scum.", "\nVILE words", " stupidly so"))
        rows.append((d, text))
        labels.append((d, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs, held = frame(spark, [*rows, (5000, None), (5001, "")]), toxicity.held_out()
    marks = spark.createDataFrame([(d, 0, y) for d, y in labels] + [(3, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks, ~held)
    assert 0 < len(model[0]) < 2000  # sparse
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(scores) == 602 and all(0 <= s <= 1 for s in scores.values())
    fold = [(scores[d], y) for d, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in fold]) > 0.97
    assert scores[5000] == scores[5001] < 0.5


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = toxic_rows(200)
    docs = frame(spark, rows)
    flip = lambda d, y: 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y
    a, b = (toxicity.fit(docs, spark.createDataFrame([(d, f(d, y)) for d, y in labels], "doc_id bigint, toxic int"), ~toxicity.held_out()) for f in (lambda d, y: y, flip))
    assert dict(zip(*map(list, a), strict=True)) == dict(zip(*map(list, b), strict=True))


def test_without_labels_nothing_is_toxic(spark):
    docs = frame(spark, corpus())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}


def test_ftrl_against_a_plain_one():
    """Weights and scores, coordinate by coordinate, with loops and dicts."""
    import math

    rows, labels = toxic_rows(60, 9)
    texts, bits, bias = [t.encode() for _, t in rows], 12, 1 << 12
    of, at = toxicity.features(texts, bits)
    own = [sorted(set(at[of == i].tolist())) + [bias] for i in range(len(texts))]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, (_, y) in zip(own, labels, strict=True):
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-max(-40, min(40, sum(w.values()))))) - y
            for i in features:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in list(n) if weight(i)}
    index, found = toxicity.train(texts, [y for _, y in labels], bits)
    assert dict(zip(index.tolist(), found.tolist(), strict=True)) == pytest.approx(want, rel=1e-9)


def test_features_against_words():
    """Words, stems, pairs and pairs with one word left out, as sets."""
    def plain(text):
        own = brute.words(brute.lower(text.translate(str.maketrans(".,;:!?\"'()[]{}", " " * 14))))
        return {*own, *(("stem", k, w[:k]) for w in own for k in toxicity.STEMS), *zip(own, own[1:], strict=False), *((a, None, b) for a, b in zip(own, own[2:], strict=False))}

    texts = ["One two, THREE two one", "two three", "", "a b a b a b", "stemming stemmed. stem", "x"]
    of, at = toxicity.features([t.encode() for t in texts], 40)
    for i, text in enumerate(texts):
        assert len(set(at[of == i].tolist())) == len(plain(text))
    both = [len(set(at[of == 0].tolist()) & set(at[of == 1].tolist())), len(plain(texts[0]) & plain(texts[1]))]
    assert both[0] == both[1] > 0


def test_toxicity_of_repeats_long_and_no_documents(spark):
    rows, labels = toxic_rows(200)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True))
    long = (rows[0][1] + " ") * 3000
    out = got(toxicity.score(frame(spark, [rows[0], rows[0], (9000, long)]), model), "doc_id", "score")
    assert len(out) == 3 and out[0] == out[1] and 0 <= out[2][1] <= 1
    assert toxicity.score(frame(spark, EMPTY), model).count() == 0
    none = toxicity.fit(frame(spark, EMPTY), marks, F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_ftrl_learns_one_coordinate():
    model = toxicity.Ftrl(10, l1=0.5)
    for i in range(200):
        model.learn(np.array([i % 2, 5, 10]), i % 2)
    w = model.weights(np.arange(11))
    assert w[1] > 1 > -1 > w[0] and w[7] == 0


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return secrets.word_ranks(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("half", [0, 1])
def test_secrets_are_told_from_code_links_and_prose(ranks, half):
    """The first half set the thresholds, the second measures them."""
    issued, harmless = secret_values.issued()[half::2], secret_values.HARMLESS[half::2]
    assert len(issued) + len(harmless) > 120
    missed = [v for v in issued if not secrets.hard_to_guess(v, ranks)]
    alarms = [v for v in harmless if secrets.hard_to_guess(v, ranks)]
    assert len(missed) <= 0.02 * len(issued) and len(alarms) <= 0.02 * len(harmless), (missed, alarms)


def test_values_that_are_no_literals(ranks):
    for v in (*secret_values.CODE[:5], *secret_values.LINKS, *secret_values.PROSE, "${X}", "<x>", "$TOKEN", "f(x)[0] and more", "f [1]", "a(b", "word " * 50_000 + "end"):
        assert not secrets.is_literal(v, ranks), v
    for v in ("MyP@ssw0rd2024!", "Zq7(v9Qx81mB7tLw", "correct horse battery staple", "k9$Vx(2", "-(", "1f(x)", "", "x" * 1_000, "word " * 50_000 + "9"):
        assert secrets.is_literal(v, ranks), v


def test_weak_passwords_are_base_spans_only(ranks):
    text = "password: Summer2024!\nsecret = 'MyP@ssw0rd2024!'\ntoken = \"Zk3+v9Q/x81mB7tLw2pa\"\npassword = os.getenv(\"DB_PASSWORD\")"
    kinds = [(text[s:e], k) for s, k, e in secrets.guess_spans(text, ranks)]
    assert kinds == [("Zk3+v9Q/x81mB7tLw2pa", 3)]
    assert len(secrets.base_spans(text)) == 3  # MyP is too short before the @


# --- 6 ------------------------------------------------------------------------


@pytest.mark.parametrize("batches, bound, salt", [(1, 10**6, 10**6), (3, 10**6, 20), (4, 0, 10**6)])
def test_substrings(spark, batches, bound, salt):
    rng = random.Random(6)
    rows = corpus(7)
    passage = prose(rng, 50, [f"p{i}" for i in range(500)])
    rows += [(70 + i, prose(rng, 30) + passage + prose(rng, i)) for i in range(8)]
    rows += [(90, "a " * 60), (91, "a b c d e " * 12), (92, passage + passage), (None, passage), (93, passage + "\x85 x"), (93, passage + "\x85 x")]
    df = substrings.dedup_substrings(frame(spark, rows), batches, max_broadcast_keys=bound, docs_per_salt=salt)
    mine = got(df.withColumn("h", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "h")
    assert mine == sorted(brute.substrings(rows), key=repr)
    assert sum(r[2] for r in mine) > 500


def test_substrings_flush_by_flush(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH_BYTES", 300)
    rows = corpus(8)
    assert got(substrings.dedup_substrings(frame(spark, rows)), "doc_id", "n_words", "n_removed") == sorted((r[:3] for r in brute.substrings(rows)), key=repr)


def test_substrings_of_nothing(spark):
    assert substrings.dedup_substrings(frame(spark, EMPTY)).count() == 0
    assert got(substrings.dedup_substrings(frame(spark, [(None, None)])), "doc_id", "n_words", "n_removed", "text") == [(None, 0, 0, "")]


def test_runs_are_compacted(spark):
    index = substrings.RunIndex(spark)
    try:
        rng, sizes = random.Random(1), []
        texts = [prose(rng, 300, [f"q{i}" for i in range(900)]) for _ in range(4)]
        for t in [*texts, texts[2]]:
            found, _ = index.add(frame(spark, [(1, t)]))
            sizes.append((len(index.runs), found.count() > 0))
        assert [n for n, _ in sizes] == [1, 1, 2, 1, 2]
        assert [f for _, f in sizes] == [False, False, False, False, True]
    finally:
        index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillspark_run")]


@pytest.mark.parametrize("bound, salt", [(10**6, 10**6), (0, 10)])
def test_batches_are_judged_without_older_texts(spark, tmp_path, bound, salt, monkeypatch):
    """Batch by batch, the index closed and opened again between them, as by
    brute force over all batches so far."""
    monkeypatch.setattr(substrings, "GROUP_ROWS", 7)
    rng, seen, path = random.Random(27), [], str(tmp_path / "index")
    passage = prose(rng, 50, [f"p{i}" for i in range(500)])
    for b in range(4):
        rows = [(1000 * b + d, t) for d, t in corpus(7 + b % 2, 40)] + [(1000 * b + 70 + i, prose(rng, 30) + passage + prose(rng, i)) for i in range(3)]
        rows += [(1000 * b + 90, None), (1000 * b + 91, passage + passage)]
        spark.createDataFrame([(d, t) for d, t in rows], "doc_id bigint, text string").write.parquet(str(tmp_path / f"batch{b}"))
        index = substrings.RunIndex(spark, path, digests=True)
        out = substrings.dedup_batch(index, spark.read.parquet(str(tmp_path / f"batch{b}")), max_broadcast_keys=bound, docs_per_salt=salt)
        seen += rows
        want = sorted((r for r in brute.substrings(seen) if r[0] >= 1000 * b), key=repr)
        assert got(out.withColumn("h", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "h") == want
        assert sum(r[2] for r in want) > 100
        index.close()
        __import__("shutil").rmtree(tmp_path / f"batch{b}")  # the texts are gone
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillspark_run")]


def test_an_index_survives_a_crash(spark, tmp_path):
    """A batch that fails before its result is written leaves nothing behind."""
    path, text = str(tmp_path / "index"), " ".join(f"k{i}" for i in range(40))
    index = substrings.RunIndex(spark, path, digests=True)
    assert substrings.dedup_batch(index, frame(spark, [(1, text)])).first()["n_removed"] == 0
    index.add(frame(spark, [(2, text + " more")]))  # and then the driver dies
    index.runs, before = [], set(os.listdir(path))
    with pytest.raises(RuntimeError, match="is open"):
        substrings.RunIndex(spark, path, digests=True)
    assert set(os.listdir(path)) == before
    index = substrings.RunIndex(spark, path, digests=True, take_over=True)
    assert set(os.listdir(path)) < before and len(index.runs) == 1
    assert substrings.dedup_batch(index, frame(spark, [(2, text + " more")])).first()["n_removed"] == 40
    index.close()
    with pytest.raises(ValueError):
        substrings.RunIndex(spark, path)
    with pytest.raises(ValueError):
        substrings.dedup_batch(substrings.RunIndex(spark), frame(spark, [(2, text)]))


def test_an_index_is_open_once(spark, tmp_path):
    """A second opener is refused and touches nothing; who was taken over from
    can commit no more."""
    path, text = str(tmp_path / "index"), " ".join(f"k{i}" for i in range(40))
    first = substrings.RunIndex(spark, path, digests=True)
    first.add(frame(spark, [(1, text)]))
    before = sorted(os.listdir(path))
    with pytest.raises(RuntimeError, match="is open"):
        substrings.RunIndex(spark, path, digests=True)
    assert sorted(os.listdir(path)) == before
    first.commit()
    second = substrings.RunIndex(spark, path, digests=True, take_over=True)
    with pytest.raises(RuntimeError, match="taken over"):
        substrings.dedup_batch(first, frame(spark, [(2, "other " + text)]))
    assert substrings.dedup_batch(second, frame(spark, [(3, text)])).first()["n_removed"] == 40
    second.close()
    assert "owner" not in os.listdir(path)


def test_a_folder_of_other_files_is_left_alone(spark, tmp_path):
    for name in ("part-0.parquet", "manifest-notes.json", "quillspark_run_1", "text.txt"):
        (tmp_path / name).write_text("precious")
    before = sorted(os.listdir(tmp_path))
    for _ in range(2):
        with pytest.raises(ValueError, match="no index"):
            substrings.RunIndex(spark, str(tmp_path), digests=True)
    assert sorted(os.listdir(tmp_path)) == before


@pytest.mark.parametrize("at", ["removed_words", "strip_words"])
def test_a_failed_batch_can_be_given_again(spark, tmp_path, monkeypatch, at):
    """To the same object, after a failure, also one that follows a compaction."""
    rng, seen = random.Random(41), []
    index = substrings.RunIndex(spark, str(tmp_path / "index"), digests=True)
    shared = prose(rng, 40, [f"p{i}" for i in range(500)])
    for b in range(3):
        rows = [(10 * b + i, prose(rng, 30, [f"q{i}" for i in range(900)]) + (shared if i else "")) for i in range(3)]
        with monkeypatch.context() as broken:
            broken.setattr(substrings, at, lambda *a, **k: 1 // 0)
            for _ in range(2):
                with pytest.raises(ZeroDivisionError):
                    substrings.dedup_batch(index, frame(spark, rows))
        out = substrings.dedup_batch(index, frame(spark, rows))
        seen += rows
        want = sorted((r for r in brute.substrings(seen) if r[0] >= 10 * b), key=repr)
        assert got(out.withColumn("h", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "h") == want
        assert sum(r[2] for r in want) >= 40
    index.close()


# --- 7 ------------------------------------------------------------------------


def test_myers_against_the_table():
    rng = random.Random(9)
    for _ in range(500):
        pattern = [rng.randrange(5) for _ in range(rng.randint(1, 70))]
        text = [rng.randrange(5) for _ in range(rng.randint(1, 60))]
        assert min(decontaminate.myers(pattern, text)) == brute.edit_distance_within(pattern, text)


def test_edit_matches(spark):
    rng = random.Random(10)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(n))) for i, n in enumerate((3, 8, 20, 40, 90))]
    items += [(5, None), (6, ""), (7, items[2][1])]
    rows = [(0, None), (1, "")]
    for d in range(2, 120):
        own = rng.choice(items[:5])[1].split()
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(own))
            kind = rng.randrange(3)
            own[at : at + 1] = [] if kind == 0 and len(own) > 1 else ["edit"] if kind == 1 else [own[at], "extra"]
        rows.append((d, f"{prose(rng, rng.randrange(30))}\n{' '.join(own).upper()}, {prose(rng, 9)}"))
    want = set()
    for d, t in rows:
        text = [w.strip(".") for w in brute.words(brute.lower(t or "").replace(",", " ").replace(".", " "))]
        for i, item in items:
            pattern = brute.words(item)
            if pattern and (least := brute.edit_distance_within(pattern, text)) <= decontaminate.budget(len(pattern), 0.15):
                want.add((d, i, least))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (20_000, 3):
        df = decontaminate.match_items(frame(spark, rows), benchmark, block_items=block)
        assert {tuple(r) for r in df.select("doc_id", "item_id", "distance").collect()} == want
    assert len(want) > 40
    assert decontaminate.match_items(frame(spark, EMPTY), benchmark).count() == 0
    assert decontaminate.match_items(frame(spark, rows), benchmark.limit(0)).count() == 0


# --- 8 ------------------------------------------------------------------------


def test_plan_of_bins():
    rng = random.Random(11)
    for capacity, n in ((10, 40), (64, 300), (4096, 2000)):
        lengths = Counter(rng.randint(1, capacity) for _ in range(n))
        plan = packing.plan_bins(lengths, capacity)
        used = Counter()
        for bins, parts in plan:
            assert bins > 0 and sum(length * copies for length, copies in parts) <= capacity
            for length, copies in parts:
                used[length] += bins * copies
        assert used == lengths
        total = sum(length * c for length, c in lengths.items())
        assert sum(b for b, _ in plan) <= -(-total // capacity) * 1.1 + 1


def test_fullest_combination():
    rng = random.Random(12)
    for _ in range(200):
        counts = np.array([0] + [rng.randrange(3) for _ in range(12)])
        room, sums = rng.randint(1, 30), {0}
        for length in range(1, 13):
            for _ in range(counts[length]):
                sums |= {s + length for s in sums if s + length <= room}
        got_ = packing.fullest(np.pad(counts, (0, 30)), room)
        assert sum(length * n for length, n in got_) == max(sums)
        assert all(0 < n <= counts[length] for length, n in got_)


def best_fit(lengths, capacity):
    """Bins that best fit decreasing takes."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - length)
    return len(rooms)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [*corpus(13), (7, "same"), (7, "same"), (None, "thea. Été, naïve... it's <|endoftext|> x1.2 ক্ষ ﬁ")]
    packed = packing.pack(frame(spark, rows), path, 256, with_ids=True)
    pieces = packed.collect()
    by_doc = defaultdict(Counter)
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            by_doc[doc][k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    mine = defaultdict(Counter)
    bins = defaultdict(list)
    for r in pieces:
        mine[r["doc_id"]][r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert mine == by_doc
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= best_fit([r["length"] for r in pieces], 256)
    assert {len(r["ids"]) for r in packing.sequences(packed).collect()} <= set(range(1, 257))
    assert packing.pack(frame(spark, EMPTY), path).count() == 0


# --- 9 ------------------------------------------------------------------------


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [1500, 4])
def test_near_duplicates(spark, percent, block):
    rng = random.Random(14)
    rows = corpus(15, 40)
    base = [f"g{i}" for i in range(60)]
    for d in range(50, 95):  # a group whose members are linked through others
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"h{rng.randrange(99)}"
        rows.append((d, " ".join(own)))
    df = neardup.near_duplicates(frame(spark, rows), percent, block=block)
    want = brute.components(rows, percent)
    assert got(df, "doc_id", "n_shingles", "component_id", "kept") == sorted(((d, n, c, d == c) for d, (n, c) in want.items()), key=repr)


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (9, a), (9, b), (9, b), (7, b), (None, a), (None, "alone here"), (None, None)]
    out = got(neardup.near_duplicates(frame(spark, rows), 80), "doc_id", "component_id", "kept")
    assert out == sorted([(5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (9, 5, False), (None, 5, False), (None, None, True), (None, None, True)], key=repr)
    assert neardup.near_duplicates(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_whose_star_fails_are_linked(spark, percent):
    """Triples of a hub h, which shares buckets with x and y but is below the
    threshold of both, and x and y, which only their shared bucket can link."""
    n, words = 2_000, 230
    changed = {80: (5, 7), 85: (3, 5)}[percent]  # single words of y and h, each of which takes five shingles
    rows, wanted = [], set()
    rng = random.Random(percent)
    for i in range(n):
        x = [f"t{i}w{j}" for j in range(words)]
        spots = [5 + 9 * j for j in range(24)]
        y, h = list(x), list(x)
        for j in rng.sample(spots, changed[0]):
            y[j] = f"y{i}w{j}"
        for j in rng.sample(spots, changed[1]):
            h[j] = f"h{i}w{j}"
        texts = [" ".join(t) for t in (h, x, y)]
        rows += [(3 * i + k, t) for k, t in enumerate(texts)]
        sets = [set(brute.shingles(t)) for t in texts]
        if 100 * len(sets[1] & sets[2]) >= percent * len(sets[1] | sets[2]):
            wanted.add(3 * i + 1)
    out = dict(got(neardup.near_duplicates(frame(spark, rows), percent), "doc_id", "component_id"))
    assert len(wanted) > 1_900 and sum(out[d] == d for d in wanted) > 1_900  # most hubs are no links
    assert not [d for d in wanted if out[d] != out[d + 1]]


def test_an_id_that_stands_for_one_of_its_sets(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a), (7, a), (7, b), (8, b)]
    assert got(neardup.near_duplicates(frame(spark, rows), 80), "doc_id", "component_id") == [(5, 5), (7, 5), (7, 5), (8, 5)]


def chain(n, groups, width=120, step=60):
    """Texts of ``width`` words, each sharing half of them with the next of its
    group: no two are near, but their buckets chain the whole group together."""
    return [(g * n + i, " ".join(f"g{g}w{k}" for k in range(i * step, i * step + width))) for g in range(groups) for i in range(n)]


def test_buckets_that_chain_stay_linear(spark):
    """Four times the documents in one chain of buckets, four times the work."""
    sent = []
    for n in (400, 1600):
        report = {}
        out = neardup.near_duplicates(frame(spark, chain(n, 1)), 80, report=report)
        assert out.where("NOT kept").count() == 0
        # Bytes at the most: a text is about 800, a sketch 252.
        sent.append(report.get("texts", 0) * 800 + report.get("sketches", 0) * 252)
    assert 0 < sent[0] and sent[1] / sent[0] < 4 ** 1.15


def test_a_large_group_is_sent_about_once(spark):
    """Near copies of a text that isn't the least of them: not all of a group is
    near the member that its buckets choose."""
    rng, base = random.Random(23), [f"g{i}" for i in range(200)]
    rows = []
    for d in range(300):
        own = list(base)
        for at in rng.sample(range(200), 0 if d == 250 else rng.randrange(1, 5)):
            own[at] = f"h{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    report, want = {}, brute.components(rows, 85)
    out = neardup.near_duplicates(frame(spark, rows), 85, report=report)
    assert got(out, "doc_id", "component_id") == sorted(((d, c) for d, (_, c) in want.items()), key=repr)
    assert report["texts"] < 6 * len(rows)


def test_sketch_agreement_is_the_similarity():
    rng = np.random.default_rng(16)
    t = 2000
    for n, both in ((400, 300), (40, 10), (5, 4), (1, 1)):
        x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - both : 2 * n - both])
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sk = neardup.sketch([a, b, a[:0]], t)
        assert (sk[:2] != np.iinfo(np.uint64).max).all() and (sk[2] == np.iinfo(np.uint64).max).all()
        assert abs(float((sk[0] == sk[1]).mean()) - want) < 0.05


def test_band_plan_misses_rarely():
    for threshold in (0.8, 0.85):
        rows = neardup.band_plan(threshold)
        assert (1 - threshold**rows) ** neardup.BANDS <= neardup.MISS < (1 - threshold ** (rows + 1)) ** neardup.BANDS


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(None, 3), (4, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = got(components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component")
    assert out == sorted(((x, find(x)) for x in root), key=repr)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 10 -----------------------------------------------------------------------


def test_sharding(spark):
    rng = random.Random(17)
    rows = [(d, rng.choice(("hot text " * 9, None, "", prose(rng, rng.randint(1, 40))))) for d in range(3000)] + [(1, "twin"), (1, "twin"), (None, "no id"), (9999, "long " * 3000)]
    out = sharding.shard(frame(spark, rows), 8, ranges_per_shard=16).collect()
    assert len(out) == len(rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    sizes, slots = Counter(), defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.02 * min(sizes.values())
    where = defaultdict(set)
    for r in out:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    hot = {zlib.crc32(("hot text " * 9).encode()), zlib.crc32(b"")}
    assert all(len(s) == 1 for (crc, _), s in where.items() if crc not in hot)


def test_splitters_against_plain_ones():
    """Boundaries after each quota of weight, key by key."""
    rng = random.Random(28)
    for _ in range(50):
        keys = [(rng.randrange(30) << 24) + rng.randrange(1 << 24) for _ in range(rng.randint(1, 80))]
        weights = [rng.randint(1, 9) for _ in keys]
        quota, want, filled, next_ = 12.0, set(), 0, 12.0
        rows = sorted(zip(keys, weights, strict=True))
        total, group = sum(weights), Counter()
        for k, w in rows:
            group[k >> 24] += w
        for k, w in rows:
            filled += w
            while next_ <= filled and next_ < total:
                want.add(k if group[k >> 24] > 2 * quota else k >> 24 << 24)
                next_ += quota
        order = np.array([k for k, _ in rows], np.int64), np.array([w for _, w in rows], np.float64)
        assert sharding.splitters(*order, quota, 2).tolist() == sorted(want)


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 20)
    rng = random.Random(29)
    docs = frame(spark, [(d, prose(rng, 3)) for d in range(2000)])
    out = sharding.shard(docs, 2, ranges_per_shard=4)
    assert sorted(r["slot"] for r in out.where("shard = 0").collect()) == list(range(out.where("shard = 0").count()))
    sizes = {r["shard"]: r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert out.count() == 2000 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_sharding_of_little(spark):
    assert sharding.shard(frame(spark, EMPTY)).count() == 0
    assert got(sharding.shard(frame(spark, [(1, None)])), "size", "text_crc32", "slot") == [(16, 0, 0)]


def test_texts_of_megabytes(spark):
    """Through licenses, decontamination and near-duplicates: found at their end,
    and alike in all but a few words."""
    rng = random.Random(51)
    vocabulary = [f"m{i}" for i in range(50_000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(250_000))
    near = long.replace(" m7 ", " changed ")
    item = " ".join(f"b{i}" for i in range(30))
    with open(os.path.join(os.path.dirname(licenses.__file__), "license_texts", "MIT.txt")) as f:
        notice = f.read()
    rows = [(1, long), (2, near + " " + item.replace("b9", "x9")), (3, long[: len(long) // 2]), (4, long + "\n" + notice)]
    assert min(len(t) for _, t in rows) > 700_000
    docs = frame(spark, rows)
    out = dict(got(neardup.near_duplicates(docs, 85), "doc_id", "component_id"))
    assert out == {1: 1, 2: 1, 3: 3, 4: 1}
    benchmark = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.match_items(docs, benchmark).select("doc_id", "item_id", "distance").collect()] == [(2, 7, 1)]
    found = licenses.scan_licenses(docs).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == {(4, "MIT")} and min(r["start_word"] for r in found) >= 249_000
