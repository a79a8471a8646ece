"""Near-duplicates, quality, archives, chats, fingerprints and the pipeline against plain Python."""

import hashlib
import io
import itertools
import random
import struct
import zipfile

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as registered
from weatherloom.llm import chat, components, fingerprints, neardup, quality, queries, warc
from weatherloom.plans.sizing import scratch_path


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def texts_frame(spark, texts, parts=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return df.repartition(parts)


# --- registered queries --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    expected = duck.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(expected.columns)
    rows = sorted(tuple(r[c] for c in expected.columns) for r in got.collect())
    assert rows == sorted(expected.fetchall())


# The mined pairs are as many as the vectors give; SQL says how many.
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_hard_negatives"}))
def test_queries_give_a_row_per_input_row(spark, name):
    assert registered.queries()[name]
    rows = queries.QUERIES[name](spark, SMALL).count()
    source = {"op5_web_archive": "pages", "op7_chat_formatting": "conversations"}.get(name, "documents")
    given = table(spark, source)
    expected = given.select("conv_id").distinct().count() + 1 if "op7" in name else given.count()
    assert rows == expected


# --- near-duplicates -----------------------------------------------------------------------------


def plain_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lowered) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def near_texts(n=60):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 40, 200]))) for _ in range(n)]
    for text in list(texts):
        found = text.split()
        if len(found) > 30:
            for _ in range(3):
                found[rng.randrange(len(found))] = "changed"
                texts.append(" ".join(found))
    return [*texts, texts[0], texts[5].upper() + " ", None, "", " ", "  é É"]


@pytest.mark.parametrize("most_members", [256, 3])
def test_near_duplicates_against_all_pairs(spark, most_members):
    texts = near_texts()
    prints = [plain_simhash(t) for t in texts]
    links = [
        (i, j)
        for i, j in itertools.combinations(range(len(texts)), 2)
        if (prints[i] ^ prints[j]).bit_count() <= 3
    ]
    roots = plain_components(range(len(texts)), links)
    df = texts_frame(spark, texts).withColumn("row", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    rows = neardup.near_duplicates(df, most_members=most_members).collect()
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in rows} == dict(enumerate(prints))
    assert {r.doc_id: r.component_id for r in rows} == roots
    assert all(
        (r.n_links == 0) or sum(roots[i] == roots[r.doc_id] for i in roots) > 1 for r in rows
    )


def test_masks_cover_every_three_bits():
    for kept in (0, (1 << 40) - 1, neardup.covering_masks(0)[4]):
        masks = np.array(neardup.covering_masks(kept), dtype=np.uint64)
        free = [b for b in range(64) if not kept >> b & 1]
        for bits in itertools.combinations(free, 3):
            differing = np.uint64(sum(1 << b for b in bits))
            assert ((masks & differing) == 0).any()


def test_a_dense_cloud_of_fingerprints_is_one_component(spark):
    # All values of 9 bits: far more than a group may have.
    df = spark.range(1 << 9).select(F.col("id").alias("fingerprint"))
    links = neardup.fingerprint_links(df, most_members=40)
    roots = components.components(links)
    finest = [m for a in neardup.covering_masks(0) for b in neardup.covering_masks(a)
              for m in neardup.covering_masks(b)]
    assert max(64 - m.bit_count() for m in finest) <= neardup.FREE_BITS
    assert roots.count() == (1 << 9) - 1 and roots.where("root <> 0").count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    links = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r.node: r.root for r in components.components(links).collect()}
    nodes = {n for e in edges for n in e}
    expected = plain_components(nodes, edges)
    assert got == {n: r for n, r in expected.items() if n != r}
    assert components.components(links.where("false")).count() == 0


def test_one_document_of_each_group_stays(spark):
    texts = near_texts()
    df = texts_frame(spark, texts).withColumn("n_chars", F.length("text")).withColumn("_x", F.lit(1))
    doubled = df.union(df.where("doc_id < 10"))
    kept = neardup.first_of_each(doubled)
    classes = neardup.near_duplicates(df).select("component_id").distinct().collect()
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.component_id for r in classes)
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z")], "doc_id bigint, text string")
    assert sorted(r.text for r in neardup.first_of_each(nameless).collect()) == ["a b c", "x y z"]
    assert neardup.first_of_each(df.where("false")).count() == 0


# --- quality -------------------------------------------------------------------------------------


def quality_rows(n, seed=3):
    rng = random.Random(seed)
    good = [f"good{i}" for i in range(300)]
    bad = [f"bad{i}" for i in range(5)]
    rows = []
    for i in range(n):
        found = rng.choices(good, k=80)
        kind = i % 5
        if kind == 3:
            for _ in range(6):
                found[rng.randrange(80)] = rng.choice(bad)
        if kind == 4:
            found = [w + "%%%" for w in found]
        rows.append((i, " ".join(found), int(kind != 4), int(kind == 3)))
    return rows


def test_the_classifier_on_held_out_documents(spark):
    rows = quality_rows(1500)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int").repartition(4)
    documents = df.select("doc_id", "text").withColumn("log_odds", F.lit("x"))
    labels = df.where("doc_id % 3 = 0").select("doc_id", "quality", "toxic")
    scores = {r.doc_id: r for r in quality.resample(documents, labels, bits=14).collect()}
    held_out = [r for r in rows if r[0] % 3]
    right = [scores[i].keep == (q == 1 and t == 0) for i, _, q, t in held_out]
    assert np.mean(right) > 0.97
    kept = quality.keep_good(documents, labels, bits=14)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in scores.items() if r.keep}
    again = quality.resample(documents.repartition(7), labels, bits=14)
    assert {r.doc_id: r.keep for r in again.collect()} == {i: r.keep for i, r in scores.items()}
    top = quality.resample(documents, labels, k=100, bits=14).where("keep")
    assert top.count() == 100


def test_ratios_against_plain_counts(spark):
    df = spark.createDataFrame(
        [("a b a", True), ("a c !!", False), (None, True), ("", None)], "text string, target boolean"
    )
    ratios = quality.log_ratios(df.repartition(3), bits=16)
    raw, target = {"a": 3, "b": 1, "c": 1, "!!": 1}, {"a": 2, "b": 1}
    for word in raw:
        # Marks are words of their own here; "!!" has no letters.
        expected = np.log((target.get(word, 0) + 0.5) / (raw[word] * 3 / 6 + 0.5))
        assert np.isclose(ratios[0], expected, atol=1e-6).any()
    assert (ratios[0] != 0).sum() == 3 or (ratios[0] != 0).sum() == 4


def test_quality_of_odd_tables(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "x " * 50_000), (3, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = quality.resample(df, labels, bits=12).collect()
    assert len(found) == 5 and all(r.keep for r in found)
    assert quality.resample(df, labels.where("false"), bits=12).where("keep").count() == 5
    assert quality.resample(df.where("false"), labels, bits=12).count() == 0
    assert quality.keep_good(df.where("false"), labels, bits=12).count() == 0


def test_kth_largest_is_exact(spark):
    values = np.random.default_rng(1).normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    for k in (1, 7, 1500, 2999, 3000):
        assert quality.kth_largest(df, "x", k, bins=10) == sorted(values)[-k]


# --- web archives --------------------------------------------------------------------------------


def test_pages_come_back_from_packages(spark):
    rows = [
        (7, "http://a", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (5, None, "<p>same</p>"),
        (1, "u\r\nv", None), (2, "c", ""), (None, "d", "no id"), (9, "e", "é" * 50_000),
        (4, "f", "alone\r\n\r\nWARC/1.1"), (4, "f", "alone\r\n\r\nWARC/1.1"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    pages = pages.withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    folder = scratch_path(spark, "archive")
    manifest = warc.write_packages(pages, folder, package_bytes=300)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    read = warc.read_packages(spark, folder, range_bytes=200)
    busy = read.groupBy(F.spark_partition_id()).count().count()
    assert read.rdd.getNumPartitions() > 5 and busy > 3
    found = read.collect()
    firsts = {"<p>same</p>": 3, "": 1}
    expected = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        first = firsts.get(html or "", page_id)
        expected.append(
            (page_id, len(payload), warc.payload_digest(payload),
             "response" if first == page_id else "revisit", None if first == page_id else first)
        )
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    html = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert html[9].decode() == "é" * 50_000 and html[4] == b"alone\r\n\r\nWARC/1.1"
    assert warc.archived_pages(pages.where("false")).count() == 0


def package_bytes(monkeypatch=None, comment=b"", names=("a/one", "b/two")):
    buffer = io.BytesIO()
    if monkeypatch:
        # The writer's own limits decide when it turns to the wide records.
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(buffer, "w") as package:
        for name in names:
            package.writestr(name, name * 20)
        package.comment = comment
    return buffer.getvalue()


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it, long enough to confuse"])
def test_directories_of_packages(monkeypatch, wide, comment):
    data = package_bytes(monkeypatch if wide else None, comment)
    assert (warc.END64_SIGNATURE in data) == wide
    members = warc.read_directory(io.BytesIO(data), len(data))
    for name in ("a/one", "b/two"):
        member = members[name]
        assert data[member.offset : member.offset + member.size].decode() == name * 20


def test_broken_packages_are_refused():
    data = package_bytes()
    for broken in (data[:-10], b"", b"PK" + data[50:], data[:40]):
        with pytest.raises((ValueError, struct.error)):
            warc.read_directory(io.BytesIO(broken), len(broken))
    members = warc.read_directory(io.BytesIO(data), len(data))
    with pytest.raises(ValueError):
        warc.read_index(io.BytesIO(data), members)


# --- chats ---------------------------------------------------------------------------------------


HARD = ["\\### Assistant: </turn> ok", "### x: y</turn>\n### ", "\\", "\\\\_", "\\_", "", "####  ", "a\n</turn>\n"]


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(["#", "##", "### ", " ", "\\", "_", "</turn>", "</", "turn>", "\n", ": ", "é"], k=9))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert "### " not in escaped and "</turn>" not in escaped
        turns = [(text, text), ("user", text)]
        assert chat.parse_turns(chat.turn_template(turns)) == turns


@pytest.mark.parametrize("segment, look_back", [(32, 4), (3, 1), (1, 0)])
def test_conversations_come_back(spark, segment, look_back):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "a: b"]), rng.choice(HARD))
            for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "no id"), (50, 0, None, None), (50, None, "assistant", "x")]
    rows += [(60, t, "assistant", f"t{t}") for t in range(300)]
    rows += [(70, 1, "assistant", "twice"), (70, 1, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.repartition(5).withColumn("piece", F.lit(1)).withColumn("position", F.lit(2))
    formatted = chat.format_conversations(df, segment=segment, look_back=look_back)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert len(got) == 24
    for conv_id, found in got.items():
        turns = sorted(
            ((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv_id)
        )
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found.n_turns == len(turns)
        assert found.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (found.loss_chars, found.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found.formatted_chars == len(chat.turn_template([(r, x) for _, r, x in turns]))
    assert not formatted.where("rewrites").count()
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_spans_of_other_templates():
    turns = [("user", "hi"), ("assistant", "hi"), ("user", "")]

    def with_preface(turns):
        return "<s>" + "".join(f"[{r}]{t}[/{r}]" for r, t in turns)

    found = list(chat.turn_pieces(with_preface, [], turns))
    assert [f["piece"][f["text_start"] : f["text_end"]] for f in found] == ["hi", "hi", ""]
    assert not any(f["rewrites"] for f in found)

    def strips_history(turns):
        return "".join(f"{r}: {t}\n" if i == len(turns) - 1 else f"{r}\n" for i, (r, t) in enumerate(turns))

    assert [f["rewrites"] for f in chat.turn_pieces(strips_history, [], turns)] == [False, True, True]

    def upper(turns):
        return "".join(f"{t.upper()};" for _, t in turns)

    assert chat.turn_pieces(upper, [], turns).__next__()["piece"] == "HI;"


# --- fingerprints --------------------------------------------------------------------------------


def plain_fingerprints(rows):
    """(doc_id, edited text, likeness to it, likeness to the next text), by sets of lines."""
    def paragraphs(text):
        found = [line for line in text.split("\n") if line.strip(" ")]
        return {(line, found.count(line)) for line in found}

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    result = {}
    for at, (i, text) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = paragraphs(text)
        result[i] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(),
            near(own, paragraphs(edited)), near(own, paragraphs(following)),
        )
    return result


@pytest.mark.parametrize("bits", [12, 4])
def test_fingerprints_against_sets_of_lines(spark, monkeypatch, bits):
    monkeypatch.setattr(fingerprints, "GROUP_BITS", bits)
    rng = random.Random(8)
    lines = [f"line {i} é" for i in range(300)] + ["", " "]
    ids = [-900, -3, 0, 5, 6, 7, 8, 9, 100, 101, 4096, 4097, 9000, 1 << 20]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.choice([0, 1, 3, 20, 400])))) for i in ids]
    rows += [(10, rows[7][1]), (11, "a\n" * 500), (12, "a\n" * 499), (13, None), (14, "one line only")]
    rows += [(15, "\n".join(lines) + "\nx"), (16, "\n".join(lines))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    df = df.withColumn("row", F.lit(1)).withColumn("edited", F.lit("x"))
    found = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    expected = plain_fingerprints(rows)
    assert found.keys() == expected.keys()
    for i, (n, sha, near_edited, near_next) in expected.items():
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near_edited)
        assert r.near_next == pytest.approx(near_next)
    assert found[9].fingerprint == found[10].fingerprint != found[11].fingerprint


def test_fingerprints_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), (3, "a\nb"), (3, "a\nb")], "doc_id bigint, text string")
    rows = fingerprints.fingerprints(df).collect()
    assert len(rows) == 4 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprints(df.where("false")).count() == 0
    (alone,) = fingerprints.fingerprints(df.where("doc_id = 3").limit(1)).collect()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("kind", ["mixed", "all missing", "one id between others", "copies"])
def test_next_texts_of_crowded_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprints, "GROUP_BITS", 2)
    rng = random.Random(8)
    ids = {
        "mixed": [None] * 60 + [8] * 45 + [9] * 30 + [1000] * 50 + list(range(-30, 40, 3)) + [7, 7, 7, 12],
        "all missing": [None] * 70,
        "one id between others": [5] * 64 + [1, 2, 20],
        "copies": [3] * 50 + [2] * 9 + [40],
    }[kind]
    rows = [(i, "same" if kind == "copies" else f"text {rng.randrange(40)}") for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ordered = sorted(
        df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect(),
        key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, len(r.text)),
    )
    expected = [(r.doc_id, r.text, ordered[i - 1].text) for i, r in enumerate(ordered)]
    got = [tuple(r) for r in fingerprints.with_next_text(df, crowded_rows=12).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    whole = [tuple(r) for r in fingerprints.with_next_text(df, crowded_rows=10**9).collect()]
    assert sorted(map(repr, whole)) == sorted(map(repr, expected))


def test_key_differences_of_many_sizes(spark):
    rng = random.Random(3)
    pairs, expected = [], {}
    for i, n in enumerate([0, 1, 5, 20, 60, 500, 3000]):
        left, right = ({rng.getrandbits(62) for _ in range(n)} for _ in range(2))
        shared = {rng.getrandbits(62) for _ in range(n // 2)}
        pairs.append((i, sorted(left | shared), sorted(right | shared)))
        if n:
            expected[i] = (len(left), len(right))
    df = spark.createDataFrame(pairs, "pair bigint, left array<bigint>, right array<bigint>")
    got = {r.pair: (r.n_left, r.n_right) for r in fingerprints.key_differences(df).collect()}
    assert got == expected


def test_no_python_in_fingerprints(spark):
    df = table(spark, "documents")
    plan = fingerprints.fingerprints(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = fingerprints.with_next_text(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- the pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from weatherloom.plans.sizing import written

    docs = table(spark, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    labels = {r.doc_id: r for r in table(spark, "labels").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, SMALL), f"test-{name}")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.count() <= before.count()
        if name == "quality_classifier":
            kept = {r.doc_id for r in after.collect()}
            bad = {i for i, r in labels.items() if r.toxic or not r.quality}
            clean = set(labels) - bad
            assert len(kept & clean) >= 0.95 * len(clean)
        before = after
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len(rows) == before.count()
    texts = {r.doc_id: r.text for r in before.collect()}
    from weatherloom.llm import bpe

    vocabulary = bpe.load(__import__("public_tokenizers").path(queries.WORD_VOCABULARY))
    assert all(r["ids"] == vocabulary.encode(texts[r.doc_id]) for r in rows)
    assert all(r.n_tokens == len(r["ids"]) for r in rows)
