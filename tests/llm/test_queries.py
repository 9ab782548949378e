"""Whole queries and hard cases of the text operators against brute force."""

import base64
import hashlib
import pstats
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vespera.llm import common, decontaminate, html_text, line_dedup, pieces, pii, quality, queries, sharding, simhash, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


# HTML


def tree(rng, depth, inline):
    if depth == 0 or rng.random() < 0.35:
        return "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 5)))
    tag = rng.choice(["span", "b"] if inline else ["div", "p", "span", "div"])
    state = rng.choice(["", "", "", "", "hidden", "none", "veiled", "seen"])
    return tag, state, [tree(rng, depth - 1, inline or tag != "div") for _ in range(rng.randint(0, 4))]


def written(node):
    if isinstance(node, str):
        return f" {node} "
    tag, state, children = node
    style = {"": "", "hidden": " hidden", "none": " style='color: red; display: none'", "veiled": " class=veiled", "seen": ' style="visibility:visible"'}[state]
    return f"<{tag}{style}>" + "".join(map(written, children)) + f"</{tag}>"


def walked(node, seen):
    if isinstance(node, str):
        yield ("word", node) if seen else ("none", "")
        return
    tag, state, children = node
    if state in ("hidden", "none"):
        return
    seen = {"veiled": False, "seen": True}.get(state, seen)
    edge = {"div": "break", "p": "gap"}.get(tag, "none")
    yield edge, ""
    for c in children:
        yield from walked(c, seen)
    yield edge, ""


def test_html_trees_are_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        nodes = [tree(rng, 5, False) for _ in range(rng.randint(0, 5))]
        text, line, gap = "", [], False
        for kind, word in [x for n in nodes for x in walked(n, True)] + [("break", "")]:
            if kind == "word":
                line.append(word)
            elif kind != "none":
                if line:
                    text += ("\n\n" if gap else "\n") * bool(text) + " ".join(line)
                    line, gap = [], False
                gap = gap or kind == "gap" and bool(text)
        page = "<style>/* x */ .veiled, .other { visibility: hidden } @media print { b { display: none } }</style>" + "".join(map(written, nodes))
        assert html_text.render(page)[0] == text, page


def test_html_layout():
    render = lambda s: html_text.render(s)[0]
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a | b\n  | c"
    assert render("<table><tr><td colspan=2>ab<td>c<tr><td>x<td>y<td>z</table>") == "ab    | c\nx | y | z"
    assert render("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c" and render("<ol><li value=5>a<li>b</ol>") == "5. a\n6. b"
    assert render("<dialog id=x>no</dialog><dialog open>yes</dialog>") == "yes" and render("<details><summary>s</summary>no</details>") == "s"
    assert render("<style>.h{display:none}</style><div class=h style='display:block'>yes</div><i class=h>no</i>") == "yes"
    assert render("<ul><li>a" * 60).count("- ") == 60


@pytest.mark.parametrize("page", ["<x><table><tr><td>" + "<b>" * 90000 + "</x>" * 90000, "<ul>" + "<span>" * 90000 + "<li>a" * 90000, "<table>" + "<tr>" + "<td rowspan=60000>a<td>b" * 20000 + "<tr><td>x" * 40000, "<table><tr><td>" + "w" * 500000 + "<td>x" + "<tr><td>a<td>b" * 30000, "<!--" * 250000, "<style>" + "/*" * 400000, "<a " + "x='" * 300000])
def test_html_work_grows_with_the_page(page):
    began = time.process_time()
    html_text.render(page)
    assert time.process_time() - began < 12 * len(page) / 1e6  # a loaded machine takes 4 s a MB; squares would take minutes


def test_html_empty_table_and_columns(spark):
    none = spark.createDataFrame([], "page_id long, html string, title string")
    assert html_text.extract_text(none).collect() == [] and set(html_text.extract_text(none).columns) == {"page_id", *html_text.COLUMNS}


# SentencePiece


def test_giants_make_real_matrices(spark):
    """On the driver's table, nearly all chunk boundaries have several states."""
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t and len(t) > pieces.CHUNK]
    data = pieces.load_model()
    shared = spark.sparkContext.broadcast(data)
    encoder = lambda: pieces.encoder_of(hashlib.sha256(data).digest(), shared)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, t string")
    found = pieces.chunk_matrices(pieces.cut_chunks(rows, encoder, pieces.CHUNK), encoder).collect()
    inner = [r for r in found if r.k > 0]
    assert len(inner) >= len(texts) > 0 and sum(len(r.m) // 8 // r.wide > 1 for r in inner) >= 0.9 * len(inner)


def test_a_long_run_without_spaces_is_the_library():
    model = pieces.PieceModel(pieces.load_model())
    rng = random.Random(6)
    text = "".join(rng.choice("theinganorst") for _ in range(100_000))
    assert model.scan(model.prepared(text), pieces.CHUNK) == model.library.encode(text)


def test_pieces_with_clashing_names(spark):
    rows = [(1, "one two", "x", 3, "r"), (1, "one two", "x", 3, "r"), (2, "a b " * 30, "y", 4, "r"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids int, __row string")
    out = pieces.encode_pieces(df, chunk=16).collect()
    library = pieces.PieceModel(pieces.load_model()).library
    assert sorted((r.doc_id or 0, r.ids or [], r.n_ids or 0, r["__row"] or "") for r in out) == sorted((d or 0, library.encode(t) if t else [], len(library.encode(t)) if t else 0, r or "") for d, t, _, _, r in rows)


def test_texts_are_encoded_once(spark, tmp_path):
    """Decoding reads the ids of the same batch; its texts aren't encoded a second time."""
    rows = [(i, f"some words and number {i}" if i % 7 else None) for i in range(50)]
    spark.conf.set("spark.sql.pyspark.udf.profiler", "perf")
    try:
        out = pieces.decode_pieces(pieces.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect()
        spark.profile.dump(str(tmp_path), type="perf")
    finally:
        spark.conf.unset("spark.sql.pyspark.udf.profiler")
        spark.profile.clear()
    calls = [(*key, n) for f in tmp_path.rglob("*.pstats") for key, (n, *_) in pstats.Stats(str(f)).stats.items()]
    assert sorted((r.doc_id, r.decoded) for r in out) == rows
    assert sum(n for file, _, name, n in calls if file.endswith("pieces.py") and name == "encode") == 1


def test_words_side_by_side_are_the_library():
    model = pieces.PieceModel(pieces.load_model())
    rng = random.Random(8)
    letters = ["abcdeth", "theingon", "aé字😀\nb", "zzzz0123", "ab \u2581", "\t▁a"]
    words = list({"".join(rng.choice(x) for _ in range(rng.randint(1, 60))) for x in letters for _ in range(400)})
    words = [w for w in words if w.rstrip(" \u2581") == w]
    assert any(len(w) >= pieces.SHORT for w in words)
    assert [np.frombuffer(x, np.int32).tolist() for x in model.segmented(words)] == model.library.encode(words)
    assert model.segmented([]) == [] and model.segmented(words[:1]) == model.segmented(words)[:1]


# Quality, lines


def test_hosts_with_mostly_bad_documents_go(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(h * 1000 + i, "bad" if i < (70 if h == 9 else 5 + h) else good, f"h{h}") for h in range(10) for i in range(100)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in out if not r.kept} == {d for d, t, h in rows if t == "bad" or h == "h9"}


def test_a_line_of_all_documents_and_a_long_text(spark):
    line, long = "A line that all documents have, in any case.", "\n".join(f"line number {i} of a long text" for i in range(170_000))
    rows = [(i, f"own {i}\n{line.upper() if i % 2 else line}  \n{'tail' * 9} {i}", "n", 7) for i in range(900)] + [(1000, long + "\n" + line, "n", 7), (1001, long, "n", 7), (1002, long, "n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string, n_lines int").repartition(4)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert all(out[i].text == f"own {i}\n{'tail' * 9} {i}" and out[i].n_dropped == 1 and out[i].n_lines == 3 for i in range(900))
    assert out[1000].text == line and out[1000].n_dropped == 170_000 and out[1001].text == "" and out[1002].text == long


# Personal data


def test_pii_query_is_brute_force(spark, tmp_path):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    rng = random.Random(8)
    parts = ["a.b@c.de", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "mail", "hotel", "é", "x1", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    put(spark, tmp_path, "documents", list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if ok(k, m[0])]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in spans) for x in patterns)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans)) and r.n_spans == len(r.scores.split(",")) * bool(r.scores)


def test_context_words_are_whole_and_on_both_sides(spark):
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = {"the ship went to 10.0.0.1": 0.6, "10.0.0.1 is the server": 0.7, "IP 10.0.0.1": 0.7, "hotel +49 30 1234567": 0.7, "+49 30 1234567 or +49 30 7654321, by telephone": 0.8, f'token = "{secret}"': 0.6, f'value = "{secret}"': None, "key = " + "a" * 40: None}
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    for r in pii.find_pii(df).collect():
        want = texts[r.text]
        assert [round(s.score, 6) for s in r.pii] == ([] if want is None else [want] * len(r.pii)) and bool(r.pii) == (want is not None), r
    row = pii.redact(df.filter("doc_id = 5")).first()
    assert row.text == 'token = "[secret]"'


# WARC


def test_warc_query_is_brute_force(spark, tmp_path):
    rng = random.Random(9)
    html = ["", "x", "é" * 40, "<p>error</p>" * 9, None] + ["".join(rng.choice("<p>abc\n") for _ in range(rng.randint(1, 900))) for _ in range(40)] + ["long " * 300_000]
    rows = [(i, f"http://h/{i}", rng.choice(html) if i % 10 == 0 else html[3]) for i in range(400)] + [(500, "u", html[-1])]
    put(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    least = {}
    for i, _, h in rows:
        least[h or ""] = min(i, least.get(h or "", i))
    want = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if least[h or ""] == i else "revisit", None if least[h or ""] == i else least[h or ""]) for i, _, h in rows)
    got = queries.op6_warc(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


# SimHash, decontamination, sharding: one key with most rows


def test_simhash_with_one_text_in_most_rows(spark):
    rng = random.Random(10)
    rows = [(i, "the same text everywhere, word for word" if i % 10 else " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))) for i in range(800)]
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == 800 and {r.component_id for r in out if r.doc_id % 10} == {1}


def test_a_k_gram_of_most_documents_and_items(spark):
    common_words = "one two three four five six seven eight nine ten"
    rows = [(i, f"start{i} {common_words} end{i}" if i % 10 else f"nothing here {i}") for i in range(600)]
    items = spark.createDataFrame([(k, f"item{k} {common_words} tail{k}") for k in range(50)], "item_id long, text string")
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), items).collect()
    assert all((r.n_hit, r.n_items) == ((10, 50) if r.doc_id % 10 else (0, 0)) for r in out) and len(out) == 600


def test_sharding_of_one_text_in_most_rows(spark):
    rng = random.Random(12)
    groups = [f"text {k}" for k in range(60)]
    rows = [(i, "hot" if i % 10 else rng.choice(groups)) for i in range(1200)] + [(None, "hot"), (5, "hot")]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 24).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == 1202 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in out for t in [dict(rows)[r.doc_id]])
    # Copies apart: against random places, the groups but the hot one are spread over few shards.
    crc = {zlib.crc32(g.encode()): g for g in groups}
    spread = Counter((r.text_crc32, r["shard"]) for r in out if r.text_crc32 in crc)
    assert len(spread) <= 2 * len({c for c, _ in spread})


# Toxicity


def test_toxicity_nulls_repeats_and_clashes(spark):
    rows = [(i, f"word{i} plain text of number {i}" + (" scummy idiot" if i % 3 == 0 else ""), "x", "y") for i in range(90)] + [(None, "scummy idiot", "x", "y"), (7, None, None, None), (91, "", "x", "y"), (30, "scummy idiot", "x", "y")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (4, None), (None, 1), (8, 7)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, score string, evidence string")
    out = toxicity.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert len({r.score for r in out if r.doc_id == 0}) == 1
    assert min(r.score for r in out if r.doc_id is None) > max(r.score for r in out if r.doc_id in (1, 2, 91))


def test_toxicity_finds_held_out_labels_and_is_calibrated(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = [r for r in queries.op9_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    score, y = np.array([r.score for r in out]), np.array([labels[r.doc_id] for r in out])
    rank = np.argsort(np.argsort(score))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    assert auc > 0.9 and ((score - y) ** 2).mean() < 0.08 and y[score >= 0.7].mean() > 0.8


# Storage


def test_written_tables_can_be_released(spark):
    import os

    common.release(spark)
    common.durable(spark.range(3).toDF("x"), "thing")
    path = common._WRITTEN[spark.sparkContext.applicationId][0].removeprefix("file://")
    assert os.path.isdir(path) and common.release(spark) == 1 and not os.path.exists(path)


def test_scratch_names_avoid_those_of_the_input(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, __doc string, __DOC_ string")
    assert common.unused(df, "doc") == "___doc" or common.unused(df, "doc").lower() not in {c.lower() for c in df.columns}


# Pipeline


def test_pipeline_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    text = lambda n=40: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    lost, twice, copied, passage = [text() for _ in range(3)], text(), text(60), text(12)
    rows = [(None, t, "en", None, None) for t in lost] + [(1, twice, None, "s", 3)] * 2 + [(2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, None, None, None, None)]
    rows += [(5, copied, "en", "s", 1), (4, copied + " one", "en", "s", 1), (None, copied, "en", "s", 1), (6, text(9) + " " + passage + " " + text(9), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    put(spark, tmp_path / "a", "documents", rows, schema)
    put(spark, tmp_path / "a", "benchmark", [(1, passage), (2, None), (None, "")], "item_id long, text string")
    library = pieces.PieceModel(pieces.load_model()).library
    want = sorted([(None, library.encode(t)) for t in lost] + [(1, library.encode(twice)), (4, library.encode(copied + " one"))], key=repr)
    assert sorted(((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()), key=repr) == want
    put(spark, tmp_path / "b", "documents", [], schema)
    put(spark, tmp_path / "b", "benchmark", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []


def test_decontamination_and_near_dedup_keep_clashing_columns(spark):
    names = ["__doc", "__row", "__text", "__id", "__head", "__n", "row", "label"]
    kind = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, *names), (2, words, *names), (3, "other words", *names), (3, "other words", *names), (None, words + " more", *names)]
    docs = spark.createDataFrame(rows, kind)
    items = spark.createDataFrame([(7, words)], "item_id long, text string")
    out = decontaminate.contamination(docs, items)
    assert out.columns == [*docs.columns, *decontaminate.COLUMNS]
    assert sorted((r.doc_id or 0, r.n_hit, r["__doc"], r["__text"]) for r in out.collect()) == [(0, 30, "__doc", "__text"), (1, 30, "__doc", "__text"), (2, 30, "__doc", "__text"), (3, 0, "__doc", "__text"), (3, 0, "__doc", "__text")]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {tuple(r[2:]) for r in kept.collect()} == {tuple(names)}
    from vespera.llm import near_copies

    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
