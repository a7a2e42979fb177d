"""Components, lines, neighbours, WARC, mixing and the pipeline."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logbrook.llm import lines, mixing, neighbours, warc
from logbrook.llm.shared import Scratch, components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(random.Random(3).randint(0, 99), k) for k in range(100, 140)], [(random.Random(k).randint(-50, 50), random.Random(k + 99).randint(-50, 50)) for k in range(70)]])
def test_components(spark, edges):
    group = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    got = [tuple(r) for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(got) == len(group) and dict(got) == {x: find(x) for x in group}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, lang string, source string, id long")


def test_lines(spark):
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words)
    near = " ".join([*words[:200], "changed", *words[200:]])
    far = " ".join(words[:200][::-1])
    rows = [(3, f"{long}\nshort one\n\nonly here"), (1, f"Short  ONE\n{near}\nx"), (2, f"{far}\nx\nX"), (4, None), (5, ""), (6, "short one"), (None, "first of all"), (7, "First of all"), (8, "twice\ntwice"), (8, "twice\ntwice")]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(documents(spark, rows)).collect()), key=str)
    want = [(3, "\nonly here", 4, 2), (1, f"Short  ONE\n{near}\nx", 3, 0), (2, far, 3, 2), (4, None, 0, 0), (5, "", 1, 0), (6, "", 1, 1), (None, "first of all", 1, 0), (7, "", 1, 1), (8, "twice", 2, 1), (8, "twice", 2, 1)]
    assert got == sorted(want, key=str)


def test_lines_of_unlike_rows_without_or_with_one_id(spark):
    """A line goes from the text that repeats it only, not from others under the same id."""
    for i in (None, 4):
        got = sorted(r.text for r in lines.dedup(documents(spark, [(i, "hello\ndup"), (i, "dup\nworld"), (i, "one\nof its own")])).collect())
        assert sorted(x for t in got for x in t.split("\n")) == ["dup", "hello", "of its own", "one", "world"]


def test_near_dedup_keeps_unlike_rows_without_or_with_one_id(spark):
    import corpus_pipeline as P

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (5, text(2)), (5, text(3)), (6, text(3)), (9, text(0))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(9, text(0)), (None, text(1)), (5, text(2)), (5, text(3))], key=str)


def test_block_simhash(spark):
    """SimHashes of up to 16 hashes are those of a plain sum."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for n in range(2, 17) for _ in range(3)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sets)], "k int, h array<long>")
    got = {r.k: r.sig & ((1 << 64) - 1) for r in df.select("k", lines.simhash(F.col("h")).alias("sig")).collect()}
    for k, x in enumerate(sets):
        u = x.view(np.uint64)
        assert got[k] == sum(1 << b for b in range(64) if 2 * int(((u >> np.uint64(b)) & np.uint64(1)).sum()) > len(u))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_every_block_is_filed(spark):
    words = [f"longword{i}" for i in range(400)]
    line = spark.createDataFrame([(" ".join(words),)], "line string").select(lines.signature(F.col("line")).alias("s"))
    hashes = sorted(r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect())
    blocks = [[]]
    for h in hashes:
        blocks[-1].append(h)
        if h % lines.PER == 0:
            blocks.append([])
    assert len(line.first().s["keys"]) == sum(len(b) >= lines.LEAST_IN_BLOCK for b in blocks) > 32


def test_a_common_passage_makes_no_pairs_of_unlike_lengths(spark, monkeypatch):
    passage = " ".join(f"passage{i}" for i in range(30))
    rows = [(i, passage + "".join(f" w{i}x{j}" for j in range(90 * i))) for i in range(3)]
    rows += [(3, rows[0][1] + " once")]
    compared = []
    inner = lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: (compared.append(pairs.count()), inner(pairs, *rest))[1])
    assert sorted((r.doc_id, r.n_removed) for r in lines.dedup(documents(spark, rows)).collect()) == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert sum(compared) == 1


def test_groups_with_a_common_passage_are_joined_part_by_part(spark, monkeypatch):
    """Two families of unlike lengths share a passage: their members are joined without verifying all pairs of a family."""
    passage = [f"passage{i}" for i in range(30)]
    own = lambda i, j: f"{(4 + 4 * (i % 2)) * 'abcdefghijk'}{j}x{i:03d}"  # noqa: E731  no word of its own is in two lines
    rows = [(i, " ".join([*(own(i, j) for j in range(7)), *passage])) for i in range(160)]
    compared = []
    inner = lines.verified
    monkeypatch.setattr(lines, "PART", 8, raising=False)
    monkeypatch.setattr(lines, "DENSE", 2, raising=False)
    monkeypatch.setattr(lines, "verified", lambda pairs, *rest: (compared.append(pairs.count()), inner(pairs, *rest))[1])
    assert sorted(r.n_removed for r in lines.dedup(documents(spark, rows)).collect()) == [0] * 2 + [1] * 158
    assert sum(compared) < 1000, compared


def test_limit_of_edits(spark):
    """The limit by anchors is never under the edit distance, and at it for replaced words."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(300)]
    pairs = []
    for _ in range(60):
        a = list(rng.choice(vocabulary, 30))
        b = [w if rng.random() > 0.1 else str(rng.choice(vocabulary)) for w in a if rng.random() > 0.03]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", lines.edits_at_most(F.col("a"), F.col("b")).alias("most")).collect()
    known = [(r.most, distance(r.a, r.b)) for r in got if r.most is not None]
    assert len(known) > 20 and all(most >= d for most, d in known) and np.mean([most <= d + 4 for most, d in known]) > 0.8


def test_lines_against_all_pairs(spark):
    """Of near lines, compared all with all, over 0.9 end up in one group, and no unlike ones do."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 11))) for _ in range(4000)]
    rows = []
    for k in range(40):
        first = list(rng.choice(vocabulary, 40))
        rows.append((k, " ".join(first)))
        for j in range(2):
            rows.append((100 * (j + 1) + k, " ".join(str(rng.choice(vocabulary)) if rng.random() < 0.08 else w for w in first)))
    text = dict(rows)
    near = {(i, j) for i in text for j in text if i < j and i % 100 == j % 100 and distance(text[i], text[j]) <= 0.2 * max(len(text[i]), len(text[j]))}
    found = {r.doc_id: r.n_removed for r in lines.dedup(documents(spark, rows)).collect()}
    assert all(found[k] == 0 for k in range(40))
    with_near = {j for i, j in near if i < 100}
    assert len(with_near) > 60 and np.mean([found[j] for j in with_near]) >= 0.9
    assert all(not found[j] for j in text if j not in {x for pair in near for x in pair})


def test_parts_of_few_members(spark, monkeypatch):
    """Members of a crowded key that are alone in their part are compared with the others."""
    monkeypatch.setattr(lines, "HOT", 8)
    monkeypatch.setattr(lines, "HOT_SAMPLE", 2)
    monkeypatch.setattr(lines, "SALTS", 100_000)
    words = [f"longword{i}" for i in range(30)]
    rows = [(i, " ".join([*words[: i % 30], f"other{i}", *words[i % 30 + 1 :]])) for i in range(120)]
    found = lines.dedup(documents(spark, rows)).collect()
    assert sorted(r.n_removed for r in found) == [0] + [1] * 119


def test_crowded_keys(spark, monkeypatch):
    """Keys with many members, dealt to parts, give the same groups."""
    monkeypatch.setattr(lines, "HOT", 8)
    monkeypatch.setattr(lines, "HOT_SAMPLE", 2)
    monkeypatch.setattr(lines, "SALTS", 4)
    words = [f"longword{i}" for i in range(30)]
    rows = [(i, " ".join([*words[: i % 30], f"other{i}", *words[i % 30 + 1 :]])) for i in range(120)]
    found = lines.dedup(documents(spark, rows)).collect()
    assert sorted(r.n_removed for r in found) == [0] + [1] * 119


def test_similar_lines(spark):
    long = " ".join(f"w{i % 3000}" for i in range(4000))
    pairs = [("abcdefghij", "abcdefghix"), ("abcdefghij", "abcdefgxyz"), ("a" * 10, "a" * 8), ("a" * 10, "a" * 7), (long, long + " more"), (long, long[:9000])]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(lines.similar("a", "b")).collect()] == [True, False, True, False, True, False]


def test_similar_long_lines(spark):
    """Up to 10,000 characters scattered edits count as edits, not by the shingles that they touch."""
    words = [f"word{i}" for i in range(1000)]
    edited = " ".join("changed" if i % 20 == 0 else w for i, w in enumerate(words))
    df = spark.createDataFrame([(" ".join(words), edited)], "a string, b string")
    assert 4000 < len(edited) <= 10_000 and df.select(lines.similar("a", "b")).first()[0]


def test_similar_lines_of_unlike_words_and_of_any_length(spark):
    """Edit similarity decides where most words have a changed letter, and above 10,000 characters too."""
    words = ["".join(chr(97 + (7 * i + 3 * j * j) % 26) for j in range(9)) for i in range(60)]
    changed = " ".join(w[:4] + "_" + w[5:] for w in words)
    long = [f"word{i}" for i in range(2000)]
    edited = " ".join("changed" if i % 20 == 0 else w for i, w in enumerate(long))
    far = " ".join("changed" if i % 3 == 0 else w for i, w in enumerate(long))
    df = spark.createDataFrame([(" ".join(words), changed), (" ".join(long), edited), (" ".join(long), far)], "a string, b string")
    assert len(edited) > 10_000
    want = [distance(" ".join(words), changed) <= 0.2 * len(changed), True, False]
    assert [r[0] for r in df.select(lines.similar("a", "b")).collect()] == want == [True, True, False]


def test_far_lines_are_told_by_their_ends(spark):
    """No line within the limit is refused by its beginning or end, and unlike ones with a common passage are, without the whole table."""
    rng = np.random.default_rng(12)
    letters = list("abcdefghijklmnopqrstuvwxyz  ä")
    text = lambda n: "".join(rng.choice(letters, n))
    near, far = [], []
    for n in [0, 1, 4, 5, 7, *rng.integers(10, 160, 60)]:
        a = b = text(n)
        for _ in range(n // 5):
            at = rng.integers(0, len(b) + 1)
            b = b[:at] + [text(1), ""][rng.integers(2)] + b[at + rng.integers(2) :]
        near.append((a, b))
    for _ in range(20):
        passage = text(60)
        far += [(text(90) + passage, text(90) + passage, True), (passage + text(90), passage + text(90), False)]
    most = "cast(floor(0.2 * greatest(length(a), length(b)) + 1e-9) as int)"
    ask = lambda df: df.select("a", "b", lines.ends_allow("a", "b", most, begin=True), lines.ends_allow("a", "b", most, begin=False), lines.similar("a", "b")).collect()
    within = [(distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9), *r[2:]) for a, b, *r in ((r[0], r[1], *r) for r in ask(spark.createDataFrame(near, "a string, b string")))]
    assert sum(w for w, *_ in within) > 30 and all(s == w and (not w or (x and y)) for w, x, y, s in within)
    for at in (True, False):
        got = ask(spark.createDataFrame([(a, b) for a, b, begin in far if begin == at], "a string, b string"))
        assert not any(r[2 if at else 3] for r in got) and all(r[3 if at else 2] for r in got) and not any(r[4] for r in got)


def test_near_lines_of_unlike_words_are_compared(spark):
    """Lines with a block in common are compared however many of their other words have a changed letter."""
    words = ["".join(chr(97 + (7 * i + 3 * j * j) % 26) for j in range(9)) + "abc"[i % 3] * (i // 26) for i in range(60)]
    same = words[:18]
    texts = [" ".join([*same, *words[18:]]), " ".join([*same, *(w[:4] + "_" + w[5:] for w in words[18:])])]
    keys = [set(r.s["keys"]) for r in spark.createDataFrame([(t,) for t in texts], "line string").select(lines.signature(F.col("line")).alias("s")).collect()]
    assert keys[0] & keys[1] and distance(*texts) <= 0.2 * len(texts[0])
    assert sorted((r.doc_id, r.n_removed) for r in lines.dedup(documents(spark, [*enumerate(texts)])).collect()) == [(0, 0), (1, 1)]


def nearest(rows, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    return {i: sorted((d, int(j)) for d, j in zip(np.sqrt(((x - v) ** 2).sum(axis=1)), ids) if j != i)[:10] for i, v in ok if i % every == 0}


def recall(got, want):
    found = defaultdict(list)
    for r in got:
        found[r.query_id].append((r["rank"], r.score, r.vec_id))
    assert set(found) <= set(want)
    for q in found:
        places = sorted(found[q])
        assert [p[0] for p in places] == list(range(1, len(places) + 1)) and [p[1:] for p in places] == sorted(p[1:] for p in places)
    return np.mean([len({p[2] for p in found[q]} & {j for _, j in w}) / max(1, len(w)) for q, w in want.items()])


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(30)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] + [1.0] * 7), (2400, [None] + [1.0] * 7), (2500, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2600, [1e300] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, id int, vector string")
    assert recall(neighbours.search(df, lambda i: i % 100 == 0).collect(), nearest(rows, 100)) == 1
    assert recall(neighbours.search(df, lambda i: i % 100 == 0, bucket=5).collect(), nearest(rows, 100)) > 0.5
    assert neighbours.search(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_neighbours_by_hashing(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 32))
    rows = [(i, (centers[i % 20] + 0.6 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(neighbours.search(df, lambda i: i % 100 == 0).collect(), nearest(rows, 100)) >= 0.9


def plain_warc(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        of = first.get(data)
        again = of is not None and page != of
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=str)


PAGES = [(1, "a", "x" * 150), (2, None, "x" * 150), (None, "b", "x" * 150), (3, "c", None), (4, "d", ""), (5, "e", "é" * 3000), (5, "e", "é" * 3000), (6, "f\r\nX: y", "é" * 3000), (7, "g", "z" * 99), (8, "g", "z" * 99), (9, "k", "a\r\n\r\nb" * 50)]


@pytest.mark.parametrize("chunk", [100, 1000, 1 << 20])
def test_warc(spark, tmp_path, chunk):
    scratch = Scratch(spark, "test")
    archive = warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), scratch, chunk=chunk)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(archive, scratch).collect()]
    assert sorted(got, key=str) == plain_warc(PAGES)
    size = warc.export_file(archive, str(tmp_path / "x.warc"))
    data = (tmp_path / "x.warc").read_bytes()
    assert len(data) == size and data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC/1.1\r\n") == len(PAGES)


def test_warc_finds_damage(spark):
    scratch = Scratch(spark, "test")
    archive = warc.write(spark.createDataFrame([(1, "a", "x" * 150)], "page_id long, url string, html string"), scratch)
    broken = archive.withColumn("data", F.encode(F.regexp_replace(F.decode("data", "utf-8"), "xx", "xy"), "utf-8"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read(broken, scratch).collect()


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def mixed(spark, n=400, weights=None, **options):
    random.seed(9)
    bad = ["scoundrel", "villain", "rogue"]
    text = lambda k: " ".join(random.choices([f"w{i}" for i in range(200)], k=50) + (random.sample(bad, 2) if k % 5 == 0 else []))
    docs = documents(spark, [(i, text(i)) for i in range(n)] + [(9000, None), (None, text(1))])
    labels = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "good") for i in range(n // 2)] + [(None, "good"), (1, None)], "doc_id long, domain string")
    return mixing.mix(docs, labels, weights or {"good": 1.0}, **options)


def test_mixing_drops_a_domain(spark):
    df, domains = mixed(spark)
    assert domains == ["bad", "good"]
    rows = {r.doc_id: r for r in df.collect()}
    assert all(rows[i].mix_copies == (i % 5 != 0) for i in range(400))
    assert rows[9000].mix_tokens == 0 and rows[None].mix_copies == 1


def test_mixing_with_very_many_features(spark, monkeypatch):
    """Words of texts that recur are significant in any number; the driver gets few of them, and all of them count."""
    random.seed(11)
    own = lambda k: " ".join(f"{'good' if k % 2 else 'bad'}{''.join(chr(97 + int(x)) for x in str(k * 30 + i))}" for i in range(30))
    docs = documents(spark, [(k + 1000 * copy, own(k)) for k in range(40) for copy in range(40)])
    labels = spark.createDataFrame([(k + 1000 * copy, "good" if k % 2 else "bad") for k in range(40) for copy in range(40)], "doc_id long, domain string")
    monkeypatch.setattr(mixing, "INLINE", 5000, raising=False)
    inline = {r.doc_id: r for r in mixing.mix(docs, labels, {"good": 1.0})[0].collect()}
    assert len(mixing.fit(docs, labels).weights) == 1200
    monkeypatch.setattr(mixing, "INLINE", 100)
    assert not mixing.fit(docs, labels).weights
    for rows in (100_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", rows)
        got = {r.doc_id: r for r in mixing.mix(docs, labels, {"good": 1.0})[0].collect()}
        assert len(got) == 1600 and got == inline


def test_mixing_finds_toxic_text_of_every_language(spark):
    """Abuse of the rarer languages counts, however many words of the most frequent one are more significant."""
    random.seed(10)
    word = lambda lang, i: lang + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    abuse = {lang: [word(f"{lang}bad", i) for i in range(n)] for lang, n in (("en", 30), ("fr", 10), ("es", 10))}
    lang = lambda k: "en" if k // 5 % 10 < 6 else "fr" if k // 5 % 10 < 8 else "es"
    text = lambda k: " ".join(random.choices([word(lang(k), i) for i in range(100)], k=40) + (random.sample(abuse[lang(k)], 9 if lang(k) == "en" else 4) if k % 5 == 0 else []))
    docs = documents(spark, [(i, text(i)) for i in range(1000)])
    labels = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "good") for i in range(1000)], "doc_id long, domain string")
    df, _ = mixing.mix(docs, labels, {"good": 1.0})
    copies = {r.doc_id: r.mix_copies for r in df.collect()}
    recall = {x: np.mean([copies[k] == 0 for k in range(0, 1000, 5) if lang(k) == x]) for x in abuse}
    assert min(recall.values()) == 1 and all(copies[k] == 1 for k in range(1000) if k % 5)


def test_mixing_meets_targets(spark):
    df, domains = mixed(spark, weights={"good": 0.5, "bad": 0.5}, most=10.0)
    size = df.agg(F.sum("mix_tokens")).first()[0]
    for k in range(2):
        got = df.agg(F.sum(F.col("mix_tokens") * F.col("mix_rate") * F.get("mix_posteriors", F.lit(k)))).first()[0]
        assert got == pytest.approx(0.5 * size, rel=0.05)
    assert df.agg(F.min("mix_rate")).first()[0] >= 0


def test_mixing_keeps_whole_domains(spark):
    """A domain that an earlier stage took nearly all of doesn't set the budget of those to keep whole, and is bounded where it abounds."""
    weights = {"good": 0.97, "bad": 0.03}
    for share, least, most in ((100, 0, 1), (2, 0, 0.1)):
        docs, labels = [], []
        for i in range(600):
            bad = i % share == 0
            docs.append((i, " ".join([f"common{'abcdefgh'[i * 7 % 8]}"] * 50 + (["scoundrel", "villain"] if bad else ["honest"]))))
            labels.append((i, "bad" if bad else "good"))
        df, _ = mixing.mix(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, domain string"), weights, whole=("good",))
        rate = {r.doc_id: (r.mix_rate, r.mix_copies) for r in df.collect()}
        assert all(rate[i] == (1, 1) for i in range(600) if i % share)
        assert least <= np.mean([rate[i][0] for i in range(0, 600, share)]) <= most


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_clean_documents_survive_quality_and_mixing(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.1"
    labels = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet")).where("domain = 'q1t0'")
    docs = Scratch(spark, "test").write(P.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "judged")
    clean = {r.doc_id for r in docs.join(labels, "doc_id").collect()}
    left = {r.doc_id for r in P.mix_sources(spark, docs, sf).select("doc_id").collect()}
    assert len(clean) > 2500 and len(clean & left) >= 0.99 * len(clean)


def test_scarce_domain_and_clashing_names(spark):
    """A domain with one labelled document takes nothing from the others; columns of any names come through."""
    docs = documents(spark, [(i, " ".join([f"common{'abcdefgh'[i * 7 % 8]}"] * 40 + ["honest"])) for i in range(300)]).withColumns({c: F.lit(1) for c in ("domain", "labelled", "its_text", "feature", "p", "rate")})
    labels = spark.createDataFrame([(i, "bad" if i == 9 else "good") for i in range(300)], "doc_id long, domain string")
    df, domains = mixing.mix(docs, labels, {"good": 0.5, "bad": 0.5}, most=2.0)
    assert set(docs.columns) < set(df.columns) and domains == ["bad", "good"]
    totals = [df.agg(F.sum(F.col("mix_tokens") * F.col("mix_rate") * F.get("mix_posteriors", F.lit(k)))).first()[0] for k in range(2)]
    natural = [df.agg(F.sum(F.col("mix_tokens") * F.get("mix_posteriors", F.lit(k)))).first()[0] for k in range(2)]
    assert totals[1] == pytest.approx(mixing.targets_for(natural, [0.5, 0.5], sum(natural), 2.0)[1], rel=0.05)
    assert df.agg(F.avg("mix_copies")).first()[0] > 0.95


def test_targets():
    assert mixing.targets_for([100, 10, 50], [0.5, 0.5, 0], 110, 1.0) == [100, 10, 0]
    assert mixing.targets_for([100, 10, 50], [0.5, 0.5, 0], 100, 2.0) == [80, 20, 0]
    assert mixing.targets_for([100, 100, 0], [0.25, 0.75, 0], 100, 1.0) == [25, 75, 0]
    assert mixing.targets_for([0, 0], [0.5, 0.5], 0, 1.0) == [0, 0]


def test_rates_solve_the_least_squares(spark):
    """The fitted rates are near the minimum that plain gradient steps reach."""
    p = np.array([[1, 0, 0], [0, 1, 0], [0.3, 0.7, 0], [0.2, 0.2, 0.6]])
    t, targets = np.array([100.0, 50, 200, 80]), np.array([150.0, 0, 60])
    natural = p.T @ t
    df = spark.createDataFrame([(x.tolist(), int(n)) for x, n in zip(p, t)], "p array<double>, tokens long")
    rates = mixing.fit_rates(df, targets.tolist(), natural.tolist())
    got = {tuple(r.p): r.r for r in df.select("p", rates.of(F.col("p")).alias("r")).collect()}
    r = np.ones(4)
    for _ in range(20000):
        r = np.clip(r - 0.5 * (p @ ((p.T @ (r * t) - targets) / natural) + mixing.RIDGE * (r - 1)), 0, 1)
    assert np.allclose([got[tuple(x)] for x in p.tolist()], r, atol=0.02)


def test_mixing_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    df, domains = mixing.mix(docs, spark.createDataFrame([], "doc_id long, domain string"), {"x": 1.0})
    assert domains == [] and [r.mix_copies for r in df.collect()] == [1, 1]
    assert mixing.mix(docs.limit(0), spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, domain string"), {"x": 1.0})[0].count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "test")
    for k, (name, stage) in enumerate(P.STAGES):
        after = scratch.write(stage(spark, docs, SF), f"stage{k}")
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns
            before = {r.doc_id for r in docs.select("doc_id").collect()}
            ids = [r.doc_id for r in after.select("doc_id").collect()]
            assert set(ids) <= before and len(ids) == len(set(ids)) and len(ids) > 50
            docs = after
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(ids)
    filled = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert filled <= 2048


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_takes_empty_and_odd_tables(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(5).unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0)], docs.schema)).withColumn("id", F.lit(1)).withColumn("place", F.lit("x"))
    for rows in (docs.limit(0), odd):
        scratch = Scratch(spark, "test")
        for k, (name, stage) in enumerate(P.STAGES):
            rows = scratch.write(stage(spark, rows, SF), f"odd{k}")
