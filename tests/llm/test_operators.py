import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vespera.llm import decontaminate, html_text, line_dedup, near_copies, pieces, pii, quality, sharding, simhash, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, hash string, pos int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def corpus():
    """Nulls, empty and long texts, repeated rows, copies, shared lines and passages."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéAB") for _ in range(rng.randint(1, 7)))
    texts = [None, "", " \n\t", "x", "one two three", ITEM, ITEM.upper(), "pre " + ITEM + " post " + ITEM, "short item", "has short item inside"]
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [texts[20]] * 5 + [texts[30] + " extra"]
    texts += [f"{word()} {word()}\nThis is a shared LICENSE line, kept once.  \n{word()}" for _ in range(6)]
    texts += [" ".join(["again and again we say it"] * 4) + f" {word()}" for _ in range(3)]
    texts += [" ".join(word() for _ in range(3000)), "z" * 5000]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", None, "clash", "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[12], (None, "a row without an id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_quality(docs, none):
    def brute(text):
        raw = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", raw)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = raw.split("\n")
        dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in raw), dup, len(covered)

    got = quality.quality_rules(docs)
    assert by_row(got, "doc_id", *quality.COUNTS) == sorted(((r[0], *brute(r[1])) for r in corpus()), key=repr)
    assert all(r.kept == (not r.base_failed) for r in got.collect())  # no host fails nearly always
    assert quality.quality_rules(none).count() == 0


def test_quality_rejects_bad_hosts(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, "bad", "spam") for i in range(400)] + [(400, good, "spam")] + [(500 + i, good, "fine") for i in range(100)]
    out = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[400] and out[500]


def test_line_dedup(docs, none):
    rows = [(-(2**63) if r[0] is None else r[0], r[1] or "") for r in corpus()]
    found = defaultdict(set)
    for d, t in rows:
        for line in t.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 20:
                found[key].add(d)
    def kept(d, t):
        lines = t.split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in lines]
        return "\n".join(x for x, k in zip(lines, keys) if not (len(found.get(k, ())) >= 3 and d != max(found[k])))
    want = sorted((kept(d, t), len(t.split("\n"))) for d, t in rows)
    assert sorted((r.text, r.n_lines) for r in line_dedup.dedup_lines(docs).collect()) == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_pii(spark, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    rng = random.Random(2)
    texts = ["".join(rng.choice("a.@+- 019()\x01b4\né") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [None, "a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111", "+1 (555) 123-4567 x", "1.1." * 2000, "12 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.pii if s.kind != "iban"] == [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, r.text or "") if ok(k, m[0])], r.text
    iban = spark.createDataFrame([(1, "GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32")], "doc_id long, text string")
    assert [(s.start, s.end) for s in pii.find_pii(iban).first().pii if s.kind == "iban"] == [(0, 27)]
    assert pii.redact(iban).first().text.startswith("[iban] and GB83")
    assert pii.find_pii(none).count() == 0


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/\r\nX: y", "same"), (1, "u", "same"), (2, "u", "other"), (4, None, None), (5, "v", ""), (None, "w", "same"), (1, "u", "same"), (6, "x", "P*M\x18\0\0\0\0 é\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    back = warc.round_trip(pages, archive_bytes=200)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in back.collect())
    assert got == Counter([(3, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (2, 5, "response", None), (4, 0, "response", None), (5, 0, "revisit", 4), (None, 4, "revisit", 1), (6, 12, "response", None)])
    assert sorted((r.page_id or 0, r.html) for r in warc.restore(back).collect()) == sorted((r[0] or 0, r[2] or "") for r in rows)
    assert warc.round_trip(pages.limit(0)).count() == 0
    broken = warc.record(1, "u", b"x" * 50)
    with pytest.raises(ValueError):
        list(warc.parse(warc._compressor(b"", 3).compress(broken[:-10])))


def fingerprint(text):
    words = (text or "").translate(LOWER)
    words = re.findall("[^\x20\x09-\x0d]+", words)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(pairs, nodes):
    up = {n: n for n in nodes}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, none):
    fps = {(r[0], r[1]): fingerprint(r[1]) for r in corpus()}
    nodes = sorted(set(fps.values()))
    root = closed([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4], nodes)
    least = {}
    for (d, _), f in fps.items():
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = sorted(((r[0], f"{fps[r[0], r[1]]:016x}", least.get(root[fps[r[0], r[1]]])) for r in corpus()), key=repr)
    assert by_row(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(none).count() == 0
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect() if r.doc_id is not None) == sorted(set(least.values()))


def test_unrelated_rows_with_null_or_reused_ids_stay(spark):
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    lost, reused, copied = [text() for _ in range(6)], [text() for _ in range(3)], text()
    rows = [(None, t, "en") for t in lost] + [(7, t, "en") for t in reused] + [(9, copied, "en"), (8, copied, "en"), (None, copied, "en"), (8, copied, "en"), (None, lost[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted([(None, t) for t in lost] + [(7, t) for t in reused] + [(8, copied)], key=repr)
    assert by_row(simhash.drop_near_duplicates(df), "doc_id", "text") == want


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("frequent", [200, 3])
def test_near_dedup_stage_is_brute_force_jaccard(spark, frequent):
    import corpus_pipeline

    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(12)]
    texts = ["", None, " ", "one two", "One  TWO", "one two three four five"]
    for _ in range(20):
        base = [word() for _ in range(rng.randint(8, 120))] + rng.choice([[], passage])
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[rng.randint(0, 3) :]))
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if alike(sets[i], sets[j])]
    want = sorted(set(closed(pairs, range(len(texts))).values()))
    far = [1 for i, j in pairs if (fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 4]
    assert len(far) > 20  # 4 bits of SimHash miss these
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df, frequent=frequent).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == want


def test_near_dedup_stage_goes_through_simhash(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(3000)]
    texts = [" ".join(base[:i] + [word()] + base[i:]) for i in range(300, 3000, 700)] + [" ".join(word() for _ in range(50)) for _ in range(3)] + ["one two", "One two"]
    fps = {simhash.fingerprint(t, 5) for t in texts}
    near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert near
    asked, found, links = [], [], simhash.links

    def spied(fps, *options):
        out = links(fps, *options)
        asked.extend(r.fp & (2**64 - 1) for r in fps.collect())
        found.extend(tuple(sorted((r.u & (2**64 - 1), r.v & (2**64 - 1)))) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "links", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [0, *range(len(texts) - 5, len(texts) - 1)]
    assert sorted(asked) == sorted(fps) and set(found) == near


def test_near_dedup_stores_less_than_its_input(spark, tmp_path):
    """A passage that all texts share has frequent shingles; the sets of all these texts are not stored for that."""
    from vespera.llm import common

    rng = random.Random(19)
    passage = " ".join(f"shared{i}" for i in range(300))
    texts = [passage + " " + " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(700)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    common.release(spark)
    assert near_copies.drop_near_copies(df).count() == len(texts)
    stored = sum(f.stat().st_size for path in common._WRITTEN[spark.sparkContext.applicationId] for f in Path(path.removeprefix("file://")).rglob("*.parquet"))
    common.release(spark)
    assert stored < sum(map(len, texts))


@pytest.mark.parametrize("crowd", [2048, 3])
def test_links_and_crowded_buckets(spark, crowd):
    rng = random.Random(5)
    found = set()
    for _ in range(15):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            found.add(x - (1 << 64) if x >> 63 else x)
    nodes = sorted(found)
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = closed(pairs, nodes)
    edges = simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"), max_bucket=crowd)
    assert {r.node: r.label for r in simhash.components(edges).collect()} == {n: want[n] for p in pairs for n in p}


def test_exploded_tables_are_not_broadcast(spark, tmp_path):
    spark.range(1, 100).selectExpr("id * 7919 AS fp").write.parquet(str(tmp_path / "fps"))
    fps = spark.read.parquet(str(tmp_path / "fps"))  # its size is known, and far below the threshold
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    for df in (simhash.links(fps), simhash._through_centres(fps)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_decontamination(docs, none, spark):
    items = [(1, ITEM), (2, ITEM), (10, "short item"), (11, None), (12, "..."), (1, ITEM)]
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = [(i, words(t)[k : k + 10]) for i, t in items for k in range(max(1, len(words(t)) - 9)) if words(t)]
    def brute(t):
        w, hit, ids = words(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    ids.add(str(i))
        return len(w), len(hit), sorted(ids), bool(hit)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert by_row(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "item_ids", "contaminated") == sorted(((r[0], *brute(r[1])) for r in corpus()), key=repr)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_block_max_index_is_exact():
    rng = random.Random(1)

    def vector():
        terms = sorted(rng.sample(range(30), rng.randint(0, 6)))
        w = np.array([rng.choice([0.5, rng.random() + 0.01]) for _ in terms])
        return np.array(terms, np.int64), w / (np.sqrt(w @ w) or 1)

    rows = [vector() for _ in range(300)]
    rows += rows[:20]  # equal cosines
    dense = np.zeros((len(rows), 30))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for block in (1, 8, 500):
        index = toxicity.BlockMaxIndex(rows, 30, block=block)
        for i in range(60):
            t, w = vector()
            cosine, skip = dense[:, t] @ w, i if i % 2 else -1
            want = sorted([(-round(c, 9), j) for j, c in enumerate(cosine) if c > 0 and j != skip])[:7]
            assert [(-round(s, 9), j) for s, j in index.search(t, w, 7, skip)] == want
    assert toxicity.BlockMaxIndex([], 30).search(np.array([3]), np.array([1.0]), 5) == []


def test_toxicity(spark, none):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice("the of and to in is it was for on as with".split()) for _ in range(40)]
        if i % 5 == 0:
            w[3] = rng.choice(["idiotic", "scummy"])
        rows.append((i, " ".join(w)))
        if i < 500:
            labels.append((i, int(i % 5 == 0)))
    df = spark.createDataFrame([*rows, (None, None), (601, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(600) if out[i].held_out]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].predicted == (i % 5 == 0) for i in range(600)) and 0 <= out[601].score < 0.7 and out[None].predicted == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(df, empty).collect()} == {0.0} and toxicity.score_toxicity(none, empty).count() == 0


@pytest.mark.parametrize("shards", [4, 24])
def test_sharding(docs, none, shards, spark):
    big = docs.select("doc_id", "text").union(spark.range(1000, 1400).select("id", F.when(F.col("id") < 1150, "hot").otherwise(F.col("id").cast("string")).alias("text")))
    rows = sharding.shard_documents(big, shards).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == big.count() and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = {r.doc_id: r.text or "" for r in big.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 8 for r in rows)
    hot = {r["shard"] for r in rows if text[r.doc_id] == "hot"}
    assert len(hot) <= -(-150 // min(counts.values())) + 2
    assert sharding.shard_documents(none, shards).count() == 0


def test_html():
    render = lambda s: html_text.render(s)[0]
    assert render("<title>t</title><p>one<p>two <b>bold</b><div hidden>no</div><script>x</script>") == "one\n\ntwo bold"
    assert render("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>") == "- a\n- b\n  3. x\n  4. y\n- c"
    assert render("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>tail") == "a    | bbb\ncccc | d\n\ntail"
    assert render("<pre>  x\n   y</pre>1 &lt; 2 <3") == "  x\n   y\n\n1 < 2 <3".strip("\n")
    assert render("") == "" and len(render("<div>" * 20000 + "deep")) == 4 and render("<p style='display: none'>a</p>b") == "b"


def test_html_controls_raw_text_and_pictures():
    render = lambda s: html_text.render(s)[0]
    assert render("a<select><option>x<option>y</select>b") == "a\nx\ny\nb"
    assert render("a<textarea>\n1 &lt; 2\n  z</textarea>b") == "a\n1 < 2\n  z\nb"
    assert render("a<xmp><b> &lt;</xmp>b") == "a\n\n<b> &lt;\n\nb" and render("a<plaintext>x</p>\ny") == "a\n\nx</p>\ny"
    assert render("a<svg><path/><defs/><desc>no</desc><text>one</text><text>two</text></svg>b") == "a one two b"
    assert render("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>") == "x=1"
    assert render("<map><area><a href=x>link</a></map>") == "link" and render("<div hidden><textarea>no</textarea></div>b") == "b"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "<p>a</p>", "x"), (2, "<p>a</p>", "x")], "page_id long, html string, text string")
    assert by_row(html_text.extract_text(pages), "page_id", "text") == [(1, None), (2, "a"), (2, "a")]


def test_max_plus_scan_is_the_library():
    model = pieces.PieceModel(pieces.load_model())
    rng = random.Random(3)
    for i in range(120):
        letters = rng.choice(["abcdeth ▁", "theingon  r", "aé字😀\n b", "zzzz0123"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(1, 100)))
        t = t.replace(" ", "") or "a" if i % 4 == 0 else t
        assert model.scan(model.prepared(t), rng.choice([1, 3, 7, 20])) == model.library.encode(t), t


def test_pieces(docs, none):
    model = pieces.PieceModel(pieces.load_model())
    for options in ({}, {"chunk": 16, "fan": 3}):
        out = pieces.decode_pieces(pieces.encode_pieces(docs, **options)).collect()
        assert len(out) == len(corpus())
        for r in out:
            assert r.ids == (None if r.text is None else model.library.encode(r.text)) and r.decoded == r.text
    assert pieces.encode_pieces(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in corpus() if r[0] is not None][:-1]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(d, t or "") for d, t, *_ in rows if quality.measure(t)[0] >= 10 and 100 * quality.measure(t)[4] <= 20 * quality.measure(t)[0]]
    seen = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t in docs:
        for x in t.split("\n"):
            seen[key(x)].add(d)
    gone = lambda d, x: len(key(x)) >= 20 and len(seen[key(x)]) >= 3 and d != max(seen[key(x)])
    docs = [(d, "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in docs]
    nodes = sorted({fingerprint(t) for _, t in docs})
    root = closed([(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4], nodes)
    heads = {}
    for d, t in docs:
        heads.setdefault(root[fingerprint(t)], (d, t))
        heads[root[fingerprint(t)]] = min(heads[root[fingerprint(t)]], (d, t))
    model = pieces.PieceModel(pieces.load_model())
    want = sorted((d, model.library.encode(t)) for d, t in heads.values() if not any(" ".join(ITEM.split()[k : k + 10]) in t.translate(LOWER) for k in range(3)))
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_kept_digest_is_of_the_text(docs):
    row = line_dedup.dedup_lines(docs).select("text", F.sha2("text", 256).alias("h")).first()
    assert row.h == hashlib.sha256(row.text.encode()).hexdigest()
