"""Brute-force versions, round trips and odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import json
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from binmine.llm import automaton, chat, components, decontaminate, packing, secrets, sharding, simhash, toxicity, url_filter, vector_join, warc
from binmine.llm.common import strings, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, fp long, score double, shard int, own int"


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 7, 0.5, 1, 2) for i, t in rows], DOCS)


# ---- 10 sharding


def placed(df):
    return df.toPandas()


def test_shards_match_the_mixture_and_are_gapless(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, i * 7) for i in range(1000)] + [(5, "a", 35)] * 3 + [(None, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, shard int")
    p = placed(sharding.interleave(df, 40))
    assert len(p) == 1004 and set(p["shard"]) == set(range(40))
    n = p.groupby("shard").size()
    assert n.max() - n.min() <= 1
    for _, g in p.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    share = p.assign(source=p["source"].fillna("-")).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (share.max(axis=1) - share.min(axis=1)).max() <= 2


def test_shards_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert placed(sharding.interleave(df, 40)).shape[0] == 1
    assert sharding.interleave(df.limit(0), 40).count() == 0


def test_sharding_runs_no_python(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    plan = sharding.interleave(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 7 chat


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices(["<", "\\", "|", "<|im_end|>", "x", "\n", "é"], k=rng.randint(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_chat_round_trip(spark):
    own = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b<|"), (1, 0, "user", own), (2, 0, "user", None), (2, 1, "user", ""), (3, None, None, "x" * 100_000), (None, 0, "system", "s"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "ro\nle<|", "t<")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_segments(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and "turn 1" in got[2].order_error and got[4].order_error
    assert chat.read_back(chat.format_segments(df.limit(0))).count() == 0


# ---- 3 archives


def test_archive_round_trip(spark, tmp_path):
    big, nasty = "é" * 60, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
    rows = [(5, "u5", big), (3, "u3", big), (9, None, big), (1, "a\r\nWARC-Type: x", "short"), (2, "u", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", nasty), (8, "u8", nasty), (None, "u0", big), (10, "ü", "z" * 300_000), (3, "u3", big)]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "w")
    back = warc.resolve_revisits(warc.read_archive(spark, path, warc.write_archive(pages, path))).toPandas()
    assert len(back) == len(rows) and back["ok"].all()
    got = sorted((None if pd.isna(r.page_id) else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in back.itertuples()) if back["page_id"].notna().all() else None
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(j for j, _, k in rows if j is not None and (k or "").encode() == b)
        again = len(b) >= 100 and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    got = [(None if pd.isna(r.page_id) else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if pd.isna(r.refers_to) else int(r.refers_to)) for r in back.itertuples()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    assert warc.read_archive(spark, path, warc.write_archive(none, path)).count() == 0


def test_only_headers_are_shuffled(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string")
    plan = warc.revisits(pages)._jdf.queryExecution().optimizedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Aggregate" in line or "Join" in line]
    assert exchanged and "html" not in " ".join(exchanged)


def test_a_revisit_without_its_original_is_not_ok(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * 200) for i in (1, 2)] + [(3, "u", "y" * 200)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    back = warc.read_archive(spark, path, warc.write_archive(pages, path))
    left = back.where("page_id != 1")
    got = {r.page_id: (r.record_type, r.refers_to, r.ok) for r in warc.resolve_revisits(left).collect()}
    assert got == {2: ("revisit", None, False), 3: ("response", None, True)}


# ---- 4 secrets

KEY = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_scanner_finds_what_the_regexes_find():
    rng, scanner = random.Random(2), secrets.Scanner()
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " ", ":", "=", '"', "'", "ab", "hunter22xyz", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", ".", "ſ", "K"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [(a, k, e) for k, a, e in scanner.spans(t) if k < 3] == base_spans(t), t


def test_private_keys_are_covered_with_their_body():
    scanner, body = secrets.Scanner(), ("MIIEow/+AB9x" * 5 + "abcd\n") * 20 + "Zm9v+A==\n"
    for kind in ("", "RSA ", "OPENSSH "):
        head, end = f"-----BEGIN {kind}PRIVATE KEY-----\n", f"-----END {kind}PRIVATE KEY-----"
        for key in (head + body + end, head + "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES,0f\n\n" + body + end, head + body.rstrip()):
            assert [s for s in scanner.spans(f"é {key}\n\nwords after") if s[0] == 4] == [(4, 2, 2 + len(key))]
    assert scanner.spans("-----BEGIN PRIVATE KEY----- starts a key") == [(4, 0, 27)]


def test_automaton_is_minimal_and_agrees_with_re():
    a = automaton.compile_patterns([("ab{2,3}c?", False), ("(x|xy)+z", True)], anchored=True)
    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choices("abcxyzXYZ", k=rng.randint(0, 6)))
        s = 0
        for b in t.encode():
            s = a.table[s][a.columns[b]]
        want = tuple(i for i, p in enumerate(("ab{2,3}c?", "(?i:(x|xy)+z)")) if re.fullmatch(p, t))
        assert a.accepts[s] == want
    assert len(automaton.compile_patterns([("a|b|c", False)], anchored=True).table) == 3


def test_secret_rows(spark):
    t = "é token = 'abcdef12' " + "f" * 30
    df = docs_of(spark, [(1, t), (2, None), (3, ""), (None, t), (1, t), (4, "x" * 400_000 + " secret=abcdefg")])
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan(df).collect()]
    want = [("assign", 2, 19), ("hex", 21, 51)]
    assert sorted(got, key=str) == sorted([(1, want), (2, []), (3, []), (None, want), (1, want), (4, [("assign", 400_001, 400_015)])], key=str)
    out = {r.doc_id: r for r in secrets.redact(df).where("doc_id is not null").collect()}
    assert out[1].text == "é [secret]' [secret]" and out[2].text is None and out[3].text == "" and out[1].fp == 7
    assert secrets.scan(df.limit(0)).count() == 0


# ---- 5 packing


@pytest.fixture(scope="module")
def tokenizer_path():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def pieces_of(n, longest=4096):
    """(start, length) of the pieces of n tokens: the largest power of two that fits, again and again."""
    out, at = [], 0
    while at < n:
        size = min(longest, 1 << ((n - at).bit_length() - 1))
        out.append((at, size))
        at += size
    return out


def encoded(w, texts):
    ids, n = w.encode(strings(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_words_are_encoded_as_the_tokenizer_does(tokenizer_path):
    w, rng = packing.Words(tokenizer_path), random.Random(5)
    parts = ["'s", "don't", "I'LL", "''ve", "a", "ß", "Ç", "é", "²", "3", "12", "!", "!!", "'", " ", "\n", "ſ", "İ", "Σ", "ΑΣ", "<|endoftext|>", "日本", "\xa0", "\x85", "e\u0301", "½"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)]
    assert w.by_words and encoded(w, texts) == [w.whole(t).tolist() for t in texts]
    w.known.limit = 40  # memory turns over, ids stay
    for i in range(0, len(texts), 50):
        assert encoded(w, texts[i : i + 50]) == [w.whole(t).tolist() for t in texts[i : i + 50]]
    long = " ".join(rng.choices(["don't", "a", "\u00e9t\u00e9", "12,", "word"], k=1_200_000))
    assert encoded(w, [long, "a"]) == [w.whole(long).tolist(), w.whole("a").tolist()]


def test_other_tokenizers_are_taken_whole(tokenizer_path, tmp_path):
    spec = json.loads(Path(tokenizer_path).read_text())
    spec["normalizer"] = {"type": "NFC"}  # does not lower-case
    (tmp_path / "other.json").write_text(json.dumps(spec))
    w = packing.Words(str(tmp_path / "other.json"))
    assert not w.by_words and encoded(w, ["One two"]) == [w.whole("One two").tolist()] != encoded(packing.Words(tokenizer_path), ["One two"])


def test_packing_rows(spark, tokenizer_path):
    rows = [(1, "hello, world " * 3), (2, None), (3, ""), (None, "x"), (1, "hello, world " * 3), (4, "word soup é " * 30_000)]
    got = packing.packed(docs_of(spark, rows), tokenizer_path).toPandas()
    assert got["sequence_id"].is_unique and (got["offset"] == 0).all()
    assert packing.packed(docs_of(spark, rows).limit(0), tokenizer_path).count() == 0
    w = packing.Words(tokenizer_path)
    want = []
    for i, t in rows:
        ids = w.whole(t or "").tobytes() + np.array([2], "<u4").tobytes()
        want += [(i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), len(ids) // 4) for a, n in pieces_of(len(ids) // 4)]
    have = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()]
    assert sorted(have, key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, rows), tokenizer_path, 100)


def test_a_bucket_holds_pieces_of_one_length(spark, tokenizer_path, tmp_path):
    rows = [(i, "word " * i) for i in range(40)]
    back = packing.write_buckets(packing.pack(docs_of(spark, rows), tokenizer_path), str(tmp_path / "b"))
    assert back.where("bucket != length or octet_length(ids) != 4 * length").count() == 0
    of = {}
    for r in back.where("bucket = 8").collect():
        of[r.doc_id] = r.ids
    w = packing.Words(tokenizer_path)
    assert set(of) == {i for i in range(40) if (i + 1) & 8}
    for i, ids in of.items():
        whole = w.whole("word " * i).tobytes() + np.array([2], "<u4").tobytes()
        at = next(a for a, n in pieces_of(i + 1) if n == 8)
        assert bytes(ids) == whole[4 * at : 4 * at + 32]


# ---- 6 url filters


def test_rules_and_hosts(spark):
    urls = ["https://A.Example.org/en/12?x", "http://example.org/es/", "http://x.example.com/de/1", "http://com/fr/", "http://b.net/org/", "nourl", None, "http://?q", "http://notexample.org/es/", "x://example.org"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, n long, bad long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, none).collect()}
    assert got == {
        0: ("a.example.org", "/en/12", "example.org/en/1", "block"), 1: ("example.org", "/es/", "example.org/es/", "block"), 2: ("x.example.com", "/de/1", "com/de/", "block"),
        3: ("com", "/fr/", "com/fr/", "allow"), 4: ("b.net", "/org/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("notexample.org", "/es/", "org/", "allow"), 9: ("example.org", "", None, "allow"),
    }


def test_reputation_shrinks_and_bounds(spark):
    rows = [("bad.spam.net", 200, 190), ("new.spam.net", 1, 1), ("good.net", 500, 10), ("also.good.net", 300, 5), ("fine.org", 400, 12), ("unseen.org", 0, 0), ("a.x.co.uk", 50, 2)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert got["bad.spam.net"].blocked and not got["good.net"].blocked and not got["unseen.org"].blocked
    assert got["new.spam.net"].posterior > got["unseen.org"].posterior  # one bad page under a bad domain
    assert all(0 < r.posterior < 1 and 0 <= r.doubt <= 1 for r in got.values())
    d = spark.createDataFrame([("a.x.co.uk",), ("1.2.3.4:80",), ("u@b.example.org:8",), ("localhost",)], "h string").select("h", url_filter.domain_of(F.col("h")).alias("d"))
    assert {r.h: r.d for r in d.collect()} == {"a.x.co.uk": "x.co.uk", "1.2.3.4:80": "1.2.3.4", "u@b.example.org:8": "example.org", "localhost": "localhost"}


def test_doubt_is_the_beta_distribution(spark):
    rng = np.random.default_rng(24)
    cases = [(0.3, 0.9, 0.4), (1.0, 1.0, 0.25), (2.5, 7.0, 0.3), (60.0, 140.0, 0.3), (60.0, 140.0, 0.36), (9e5, 2.1e6, 0.3001), (0.2, 50.0, 0.01), (400.0, 3.0, 0.99)]
    df = spark.createDataFrame(cases, "a double, b double, x double")
    total = f"aggregate(sequence(0, {url_filter.STEPS - 1}), 0D, (t, i) -> t + {{0}})"
    for r in df.withColumn("p", F.expr(url_filter.below("a", "b", "x", total))).collect():
        assert abs(r.p - (rng.beta(r.a, r.b, 400_000) <= r.x).mean()) < 0.004, r


def test_suffix_lists():
    assert url_filter.read_suffixes(["// a comment", "", "com", "co.uk", "*.ck", "!www.ck", " b.c.d  // note", "GitHub.io"]) == ("b.c.d", "co.uk", "github.io")


def test_longer_suffixes_come_first(spark):
    df = spark.createDataFrame([("x.a.b.c.d",), ("b.c.d",), ("c.d",), ("q.e",)], "h string")
    got = [(r.s, r.d) for r in df.select(url_filter.suffix_of(F.col("h"), ("b.c.d", "c.d")).alias("s"), url_filter.domain_of(F.col("h"), ("b.c.d", "c.d")).alias("d")).collect()]
    assert got == [("b.c.d", "a.b.c.d"), ("b.c.d", "b.c.d"), ("c.d", "c.d"), ("e", "q.e")]


def test_odd_pages_and_labels_give_outcomes(spark):
    pages = spark.createDataFrame([(1, "http://a.b/7"), (2, "http://a.b/7"), (3, "http://a.b/x"), (4, None), (5, "http://c.d/99999999999999999999"), (6, "http://c.d/8")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, None), (8, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.host: (r.n, r.bad or 0) for r in url_filter.labelled_outcomes(pages, labels).collect()}
    assert got == {"a.b": (2, 2), "": (0, 0), "c.d": (1, 0)}
    assert url_filter.labelled_outcomes(pages.limit(0), labels).count() == 0


# ---- 8 simhash


def plain_fingerprint(t):
    w = [x.encode() for x in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps, radius=3):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_pairs_are_all_pairs_within_the_radius():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps, group = [], []
    for g, n in enumerate((1, 2, 150, 70, 1, 40)):
        for _ in range(n):
            x = int(base[g])
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.append(x)
            group.append(g)
    for radius in (1, 3, 4):
        got = {(min(a, b), max(a, b)) for i, j in simhash.near_pairs(np.array(fps, np.uint64), np.array(group), radius) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and (fps[i] ^ fps[j]).bit_count() <= radius}
        assert got == want


def test_simhash_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(40, 400))
        rows.append((3 * i, " ".join(t)))
        for c in range(rng.randint(0, 3)):
            u = list(t)
            u[rng.randrange(len(u))] = "x"
            rows.append((3 * i + 500 + c * 1000, " \t".join(u).upper()))
    rows += [(9001, None), (9000, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (None, "one"), (7, "é İ ſ"), (7, "é İ ſ"), (9005, "long " * 200_000), (None, "alone words here now")]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], fps, plain_components([i for i, _ in rows], fps), strict=True))
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def test_split_buckets_lose_nothing(spark):
    rng = np.random.default_rng(8)
    fps = {int(sum(1 << int(b) for b in rng.integers(0, 20, 3))) for _ in range(300)}
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(fps))], "fp long, rep long")
    whole = {tuple(r) for r in components.connected_components(simhash.near_links(classes)).collect()}
    parts = {tuple(r) for r in components.connected_components(simhash.near_links(classes, part=16)).collect()}
    assert whole == parts


def plain_shingles(text, size=5):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_copies(rows, jaccard=0.8):
    """The smallest id of each row's component, all pairs compared by their sets of shingles."""
    ids = sorted({i for i, _ in rows})
    sets = {i: plain_shingles(t) for i, t in reversed(rows)}
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both, small, large = len(sets[a] & sets[b]), *sorted((len(sets[a]), len(sets[b])))
            if small >= jaccard * large and both >= jaccard * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: find(i) for i in ids}


def copies_table(seed=21):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows, i = [], 0
    for group in range(60):
        base = [word() for _ in range(rng.randint(6, 400))]
        for _ in range(rng.choice([1, 1, 2, 3, 30])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = word()
            rows.append((i, " ".join(t).capitalize()))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE  two"), (1005, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [4096, 8])
def test_near_copies_against_all_pairs(spark, part):
    rows = copies_table()
    want = plain_copies(rows)
    extra = [(None, rows[0][1]), (rows[0][0], rows[0][1])]
    got = simhash.near_copies(docs_of(spark, rows + extra), part=part).collect()
    assert len(got) == len(rows) + 2
    have = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert [r.component_id for r in got if r.doc_id is None] == [want[rows[0][0]]]
    wrong = [i for i in want if want[i] != have[i]]
    assert len(set(want.values())) < 90 and len(wrong) <= 0.02 * len(want)
    kept = simhash.without_near_copies(docs_of(spark, rows + extra))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, c in have.items() if i == c} | {None} and "own" in kept.columns
    assert simhash.near_copies(docs_of(spark, rows).limit(0)).count() == 0


def test_large_groups_of_near_copies_are_one_component(spark):
    rng = random.Random(22)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(1500):
        t = list(base)
        t[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(t)))
    assert {r.component_id for r in simhash.near_copies(docs_of(spark, rows)).collect()} == {0}


def test_bits_of_wide_fingerprints_differ_as_the_angle_says():
    rng, far = np.random.default_rng(23), []
    sure, most = simhash.radii(0.8, 512, (2.5, 2.5))
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
        y = np.unique(np.concatenate([x[56:], rng.integers(0, 1 << 63, 56, dtype=np.uint64)]))  # 444 of 556 in common
        a, b = (np.frombuffer(simhash.wide_fingerprint(np.unique(s), 8), np.uint64) for s in (x, y))
        far.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(far) - (sure + most) / 2) < 3 and max(far) <= most + 10 and min(far) >= sure - 10


def test_wide_pairs_within_any_radius():
    rng = np.random.default_rng(26)
    base = rng.integers(0, 1 << 63, (40, 4), dtype=np.uint64)
    fps = np.repeat(base, 6, axis=0)
    flips = rng.random((240, 256)) < rng.choice([0.02, 0.1, 0.2, 0.5], 240)[:, None]
    fps ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    group = np.sort(rng.integers(0, 9, 240))
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    for radius in (0, 5, 8, 31, 53, 127):
        got = {(min(a, b), max(a, b)) for i, j in simhash.near_pairs(fps, group, radius) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(a, b) for a in range(240) for b in range(a + 1, 240) if group[a] == group[b] and far[a, b] <= radius}
        assert got == want


def test_one_document_of_each_component_stays(spark):
    df = docs_of(spark, [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, "other words entirely in here"), (None, "a b c d e f")])
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, None], key=str)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    random.Random(9).shuffle(chain)
    e = spark.createDataFrame(chain, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components.connected_components(e.limit(0)).count() == 0


# ---- 2 vectors


def plain_links(rows, cosine):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows[:i]):
            if a is not None and b is not None and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    p, q = find(i), find(j)
                    up[max(p, q)] = min(p, q)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    return [(a, n[i], least.get(find(i))) for i, (a, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(10)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(8)
        for _ in range(rng.integers(1, 16)):
            rows.append((len(rows) * 7 % 1009, (centre + 0.18 * rng.standard_normal(8)).astype(np.float32).tolist()))
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [(3000, None), (3001, [0.0] * 8), (3002, []), (3003, [float("nan")] * 8), (3004, [float("inf")] + [0.0] * 7), (3005, [None] * 8), (3006, [1.0] * 3), (3007, [2.0] * 3), (None, rows[0][1]), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = vector_join.near_vectors(df, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted(plain_links(rows, 0.95), key=str)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_join.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def test_distant_intervals_are_skipped():
    x = np.vstack([np.eye(4)[[0]] + 0.01 * np.random.default_rng(1).standard_normal((40, 4)), np.eye(4)[[1]] + 0.01 * np.random.default_rng(2).standard_normal((40, 4))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = sum(len(i) for i, _ in vector_join.join_blocks(x, None, np.eye(4), 0.95, leaf=8))
    assert n == 2 * 40 * 39 // 2


# ---- 9 toxicity


def brute_segments(s):
    """Ruzzo and Tompa's definition, recursively: the best segment, then what is left of it and right of it."""
    best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    _, _, _, a, b = best
    return brute_segments(s[:a]) + [(a, b, best[0])] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(11)
    for _ in range(200):
        s = rng.integers(-4, 4, rng.integers(0, 14)) + rng.random() * 1e-3
        got = toxicity.maximal_segments(np.array(s, float))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(list(s))]


@pytest.fixture(scope="module")
def toxic_tables(spark):
    rng = random.Random(12)
    plain = ["".join(rng.choices(["ba", "do", "ki", "lu", "me"], k=rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        t = rng.choices(plain, k=rng.randint(30, 200))
        bad = i % 6 == 0
        for _ in range(rng.randint(2, 6) if bad else 0):
            t[rng.randrange(len(t))] = "vile" + rng.choice(["x", "ny", "st", "or", "un"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad), "v"))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_held_out_accuracy(spark, toxic_tables):
    docs, labels = toxic_tables
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").withColumn("out", toxicity.held_out(F.col("doc_id"))).where("out").toPandas()
    assert {int(i) for i in scored["doc_id"]} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (((scored["score"] >= toxicity.THRESHOLD).astype(int) == scored["toxic"]).mean()) > 0.97
    found = (scored["n_passages"] > 0).groupby(scored["toxic"]).mean()
    assert found[1] > 0.2 and found[0] < 0.02


def test_lambda_makes_the_mean_of_clean_scores_one(spark):
    """Clean texts hold toxic words too, one in fifty, in toxic texts they stand together."""
    rng = random.Random(32)
    plain = ["".join(rng.choices(["ba", "do", "ki", "lu", "me"], k=rng.randint(1, 4))) for _ in range(400)]
    vile = ["vile" + x for x in ("x", "ny", "st", "or", "un")]
    rows = []
    for i in range(800):
        t = [rng.choice(vile) if rng.random() < 0.02 else rng.choice(plain) for _ in range(rng.randint(30, 200))]
        if i % 5 == 0:
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(vile) if rng.random() < 0.6 else rng.choice(plain) for _ in range(20)]
        rows.append((i, " ".join(t)))
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    train = toxicity._training(docs, labels, toxicity.FIT_ROWS)
    m = toxicity.fit(docs, labels)
    rows = train.collect()
    halves = []
    for f in (0, 1):
        c = toxicity.Counts()
        for r in rows:
            if r.fold == f:
                c.add(r.text, r.toxic)
        halves.append(toxicity.Scorer(toxicity.Model.of(c.tokens, c.prefixes)))
    scores = np.concatenate([halves[1 - r.fold].scores(r.text) for r in rows if not r.toxic])
    assert abs(np.exp(m.lam * scores).mean() - 1) < 0.05 and scores.mean() < 0 < scores.max() and m.lam != 1.0
    got = toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), m).toPandas()
    found = (got["n_passages"] > 0).groupby(got["doc_id"] % 5 == 0).mean()
    assert found[True] > 0.7 and found[False] < 0.05


def test_evalues_of_random_walks():
    """Scores +1 with 0.3 and -1 with 0.7: lambda is log(7 / 3), and E-values count chance segments."""
    rng, n = np.random.default_rng(25), 300
    lam = toxicity.solve_lambda(np.array([1.0, -1.0]), np.array([0.3, 0.7]))
    assert abs(lam - math.log(7 / 3)) < 1e-6
    best = lambda size: np.array([max((s for _, _, s in toxicity.maximal_segments(np.where(rng.random(size) < 0.3, 1.0, -1.0))), default=0.0) for _ in range(3000)])
    log_k = toxicity.gumbel_log_k(lam * best(n) - math.log(n), np.ones(3000), toxicity.LOW)
    for size in (300, 900):
        m = best(size)
        for e in (0.3, 0.1, 0.03):
            got = (log_k + math.log(size) - lam * m <= math.log(e)).mean()
            assert 0.3 * (1 - math.exp(-e)) < got < 2.2 * (1 - math.exp(-e))  # scores are whole numbers, so E-values jump
    assert toxicity.solve_lambda(np.array([1.0]), np.array([1.0])) == 1.0 and toxicity.gumbel_log_k(np.array([-20.0]), np.ones(1), -20.0) == 0.0


def test_held_out_labels_are_never_learnt(spark, toxic_tables):
    docs, labels = toxic_tables
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(docs, labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (a.tokens == b.tokens).all() and (a.slope, a.intercept, a.log_k) == (b.slope, b.intercept, b.log_k)


def test_odd_texts_and_tables_score(spark, toxic_tables):
    docs, labels = toxic_tables
    m = toxicity.fit(docs, labels)
    odd = docs_of(spark, [(1, None), (2, ""), (None, "vilex viley"), (3, "ba " * 200_000), (3, "ba " * 200_000)])
    got = toxicity.score(odd, m).toPandas()
    assert len(got) == 5 and got["score"].between(0, 1).all()
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.score(odd, None).toPandas()["score"].eq(0).all()
    assert toxicity.without_toxic(odd, None).count() == 5 and toxicity.score(odd.limit(0), m).count() == 0
    kept = toxicity.without_toxic(docs, m)
    assert kept.columns == docs.columns and 700 < kept.count() < 800


# ---- 1 decontamination


def test_common_subsequence():
    def plain(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(13)
    for _ in range(300):
        a, b = rng.choices("abcde", k=rng.randint(1, 90)), rng.choices("abcdef", k=rng.randint(0, 90))
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def test_randomised_svd_finds_the_row_space(spark):
    rng = np.random.default_rng(14)
    a = rng.standard_normal((30, 5)) @ rng.standard_normal((5, 40))
    m = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "term array<int>, weight array<double>").repartition(3)
    v, held = decontaminate.randomised_svd(m, 40, 5)
    assert v.shape == (40, 5) and np.allclose(a @ v @ v.T, a, atol=1e-6) and np.isclose(held, (a * a).sum())


def test_the_space_grows_until_it_holds_the_energy(spark):
    rng = np.random.default_rng(18)
    rows = [(list(range(60)), (x / np.linalg.norm(x)).tolist()) for x in rng.standard_normal((40, 60))]
    v = decontaminate.latent_space(spark, rows, 60, decontaminate.Settings(rank=4, extra=2))
    a = np.array([x for _, x in rows])
    assert v.shape[1] > 20 and ((a @ v) ** 2).sum() >= 0.95 * 40


def test_leaks_exact_edited_and_clean(spark):
    rng = random.Random(15)
    words = ["".join(rng.choices(["an", "er", "th", "on", "ti", "sh"], k=rng.randint(1, 5))) for _ in range(3000)]
    text = lambda n: rng.choices(words, k=n)
    items = [(k, text(rng.randint(15, 60))) for k in range(30)] + [(50, text(400)), (51, ["rare1", "rare2", "rare3"])]
    docs, want = [], set()
    for i in range(300):
        t = text(rng.randint(80, 300))
        if i % 3 == 0:
            k, w = items[i // 3 % 32]
            w = list(w)
            if i % 2 and len(w) > 10:
                for _ in range(len(w) // 10):
                    w[rng.randrange(len(w))] = rng.choice(words)
            at = rng.randrange(len(t))
            t = t[:at] + w + t[at:]
            want.add((i, k))
        docs.append((i, ". ".join(" ".join(t[j : j + 9]) for j in range(0, len(t), 9)).capitalize()))
    docs += [(1000, None), (1001, ""), (None, docs[0][1]), (0, docs[0][1]), (1002, " ".join(text(40_000) + items[1][1]))]
    want |= {(None, items[0][0]), (1002, items[1][0])}
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in items] + [(90, None, 1), (91, "", 1)], "item_id long, text string, doc_id int")
    frame = docs_of(spark, docs)
    got = decontaminate.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1  # the repeated row has its own
    clean = decontaminate.without_leaks(frame, bench)
    assert clean.columns == frame.columns and clean.count() == frame.count() - len(got)
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0 and decontaminate.leaks(frame.limit(0), bench).count() == 0
    small = decontaminate.Settings(block=7, group=14)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, small).collect()} == want


def matcher_of(words, n, df, answer=()):
    """A matcher of one passage in the space of all its block's terms, 60 of them from other passages."""
    terms = decontaminate.Terms(sorted({*words, *(f"other{i}" for i in range(60))}))
    idf = np.log((n + 1.0) / (np.array([df.get(t, 5) for t in terms.terms]) + 1.0)) + 1e-3
    return decontaminate.Matcher([decontaminate.Passage(1, words, list(answer))], terms, idf, np.eye(terms.none), decontaminate.Settings())


def found_by(m, text):
    return [item for _, item in decontaminate.matches([m], strings([text]))]


@pytest.mark.parametrize("n", [3_000, 300_000, 20_000_000])
@pytest.mark.parametrize("share", [1.0, 0.33, 0.1])
def test_leaks_in_a_large_share_of_all_documents_are_found(n, share):
    words = [f"leaked{i}" for i in range(17)]
    m = matcher_of(words, n, {w: int(n * share) for w in words})
    near = [f"other{i}" for i in range(60)]  # rare words on both sides
    assert found_by(m, " ".join(near[:25] + words + near[25:])) == [1]
    assert found_by(m, " ".join(near * 70 + words[:16] + near)) == [1]
    assert not found_by(m, " ".join(near + words[:9] + near)) and not found_by(m, " ".join(near))


def test_paraphrases_that_fill_half_a_window_are_found():
    words = [f"item{i}" for i in range(20)]
    m, rng, found = matcher_of(words, 10_000, {}), random.Random(16), 0
    for _ in range(50):
        near, copy = rng.sample([f"other{i}" for i in range(60)], 60), list(words)
        for i in rng.sample(range(20), 4):
            copy[i] = near[i]
        at = rng.randrange(20, 40)
        found += found_by(m, " ".join(near[:at] + copy + near[at:])) == [1]
    assert found == 50


def block_matchers(items, texts, s):
    """Matchers in the exact space of each block."""
    p = [decontaminate.Passage(i, w, []) for i, w in enumerate(items)]
    terms = decontaminate.Terms(sorted({w for x in p for w in x.words}))
    idf = np.log((len(texts) + 1.0) / (terms.frequencies(strings(texts)) + 1.0)) + 1e-3
    out = []
    for at in range(0, len(p), s.block):
        a = np.zeros((len(p[at : at + s.block]), terms.none))
        for i, x in enumerate(p[at : at + s.block]):
            for w in x.words:
                a[i, terms.number[w]] += idf[terms.number[w]]
        _, v, t = np.linalg.svd(a / np.linalg.norm(a, axis=1, keepdims=True), full_matrices=False)
        rank = int(np.searchsorted(np.cumsum(v * v), s.energy * len(a))) + 1
        out.append(decontaminate.Matcher(p[at : at + s.block], terms, idf, t.T[:, :rank], s))
    return out, terms, idf


def accepted(item, region, terms, idf, s):
    """The rule itself: enough of the passage in common, or less of it with the five rarest words."""
    share = decontaminate.common_subsequence(item, region) / len(item)
    rare = sorted(set(item), key=lambda w: (-idf[terms.number[w]], w))[: s.seldom]
    return share >= s.same or share >= s.near and sum(w in region for w in rare) / len(rare) >= s.answer


@pytest.fixture(scope="module")
def real_words():
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    return [w for w in (decontaminate.WORDS((t or "").lower()) for t in pd.read_parquet(path)["text"]) if len(w) > 80]


def test_recall_of_paraphrases_by_share_of_replaced_words(real_words):
    rng, s = random.Random(19), decontaminate.Settings()
    items = []
    while len(items) < 500:
        w, n = rng.choice(real_words), rng.randint(16, 60)
        a = rng.randrange(len(w) - n)
        items.append(w[a : a + n])
    found, terms, idf = block_matchers(items, [" ".join(w) for w in real_words], s)
    every = [w for d in real_words for w in d]
    for share in (0.1, 0.2, 0.3, 0.38):
        texts, truth = [], []
        for i, item in enumerate(items):
            copy, d = list(item), rng.choice(real_words)[:300]
            for j in rng.sample(range(len(copy)), int(share * len(copy))):
                copy[j] = rng.choice(every)
            at = rng.randrange(len(d))
            texts.append(" ".join(d[:at] + copy + d[at:]))
            if accepted(item, copy, terms, idf, s):
                truth.append((i, i))
        got = decontaminate.matches(found, strings(texts))
        assert len(truth) > 100 and sum(x in got for x in truth) >= 0.98 * len(truth)


def test_leaks_against_the_subsequence_rule_at_every_place(real_words):
    rng, s = random.Random(20), decontaminate.Settings(block=16)
    items = [w[:n] for w, n in zip(rng.sample(real_words, 40), rng.choices(range(9, 60), k=40), strict=True)]
    texts = []
    for i in range(60):
        d, item = rng.choice(real_words)[:250], list(items[i % 40])
        for j in rng.sample(range(len(item)), int(rng.choice([0, 0.15, 0.35, 0.6]) * len(item))):
            item[j] = "replaced"
        for _ in range(i % 4):
            item.insert(rng.randrange(len(item)), "inserted")
        at = rng.randrange(len(d))
        texts.append(d[:at] + item + d[at:])
    found, terms, idf = block_matchers(items, [" ".join(w) for w in real_words], s)
    want = set()
    for t, d in enumerate(texts):
        for k, item in enumerate(items):
            size = next(x for x in s.sizes if x >= len(item))
            if len(set(item) & set(d)) >= s.near * len(set(item)) / 2 and any(accepted(item, d[a : a + size + size // 4], terms, idf, s) for a in range(0, len(d), 2)):
                want.add((t, k))
    got = set(decontaminate.matches(found, strings([" ".join(d) for d in texts])))
    assert len(want) > 40 and len(want & got) >= 0.98 * len(want)
    assert all(any(accepted(items[k], texts[t][a : a + 3 * len(items[k]) + 48], terms, idf, s) for a in range(len(texts[t]))) for t, k in got)


def test_places_do_not_depend_on_the_batch(real_words):
    s = decontaminate.Settings()
    items = [w[5:40] for w in real_words[:50]]
    texts = [" ".join(w) for w in real_words[:120]]
    found, _, _ = block_matchers(items, texts, s)
    alone = {(i, item): x for i, t in enumerate(texts) for (_, item), x in decontaminate.matches(found, strings([t])).items()}
    assert decontaminate.matches(found, strings(texts)) == alone and len(alone) >= 50


def test_written_tables_are_read_from_the_shared_folder(spark):
    df, path = written(spark.range(3), "t")
    assert path.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")) and df.count() == 3
