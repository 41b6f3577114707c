"""Per-document operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventpulse.llm import bpe, byte_bpe, html_text, licenses, packing, quality, secrets, token_counts
from eventpulse.llm.wordblocks import word_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(params=["odd", "small", "none"])
def documents(request, spark, small, odd_documents):
    table = spark.read.parquet(f"{small}/documents.parquet")
    return {"odd": odd_documents, "small": table, "none": table.limit(0)}[request.param]


def same(found, expected):
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_quality_measures(documents):
    def measures(t):
        words, seen, repeated = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        counts, covered = Counter(zip(words, words[1:], words[2:])), set()
        for i in range(len(words) - 2):
            if counts[tuple(words[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        n = len(words)
        return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n

    found = [tuple(r[c] for c in ("doc_id", *quality.MEASURES, "base_failed")) for r in quality.quality_rules(documents, ["doc_id"]).collect()]
    same(found, [(r["doc_id"], *measures(r["text"] or "")) for r in documents.collect()])


def test_bad_hosts_are_rejected_and_good_ones_kept(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "x " * 80
    rows = [(i, good if i % 10 else bad, f"good{i % 5}") for i in range(400)] + [(1000 + i, bad if i % 20 else good, "bad") for i in range(400)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"])
    kept = {(r["source"][:4], r["kept"]): r["n"] for r in out.filter("not base_failed").groupBy("source", "kept").agg(F.count("*").alias("n")).collect()}
    assert ("bad", False) in kept and ("bad", True) not in kept and not any(s == "good" and not k for s, k in kept)
    assert quality.kept_by_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == out.filter("kept").count()


def test_symbols_and_repeated_lines_fail_and_count_for_hosts(spark):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(8))
    symbols, lines = good.replace(" ", "$$ "), "\n".join([" ".join(f"w{i}" for i in range(60))] + [f"only {i}" for i in range(3)] + ["end"] * 4)
    rows = [(i, (symbols, lines)[i % 2] if i // 20 % 10 == 0 else good, f"average{i % 20}") for i in range(4000)] + [(5000 + i, symbols if i % 20 < 9 else good, "bad") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.quality_rules(docs, ["doc_id", "source"])
    kept = {r["doc_id"] for r in out.filter("kept").collect()}
    assert out.filter("base_failed").count() == 0
    assert kept == {i for i, t, host in rows if t == good and host != "bad"} == {r["doc_id"] for r in quality.kept_by_quality(docs).collect()}


def test_a_host_that_fails_one_rule_goes(spark):
    """And the SQL agrees on a table on which hosts go."""
    import duckdb

    from eventpulse.llm import oracle

    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(8))
    lines = "\n".join([" ".join(f"w{i}" for i in range(60))] + [f"only {i}" for i in range(3)] + ["end"] * 4)
    short, cjk = " ".join("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " ".join("漢字仮名交文" * 3 + str(i) for i in range(60))
    rows = [(i, (lines, short)[i % 2] if i // 30 % 10 == 0 else (good, cjk)[i % 2], f"average{i % 30}") for i in range(6000)]
    rows += [(7000 + i, lines if i % 20 < 9 else good, "lines") for i in range(300)] + [(8000 + i, short if i % 20 < 9 else good, "short") for i in range(300)] + [(9000 + i, good, None) for i in range(5)] + [(9100, lines, "new"), (9101, good, "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality.quality_rules(docs, ["doc_id"])
    found = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert {i for i, kept in found.items() if kept} == {i for i, t, host in rows if t in (good, cjk) and host not in ("lines", "short")}
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    assert dict(db.execute(f"SELECT doc_id, kept FROM ({oracle.QUALITY_RULES})").fetchall()) == found
    with pytest.raises(ValueError, match="clash"):
        quality.quality_rules(docs.withColumnRenamed("doc_id", "n_words"), ["n_words"])
    names = docs.withColumnsRenamed({"doc_id": "_body", "text": "_row", "source": "n_words"})
    assert quality.kept_by_quality(names, host="n_words", text="_row").columns == names.columns


def test_base_secrets(documents):
    def base(t):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)).encode()).hexdigest()

    found = secrets.secret_spans(documents, ["doc_id"]).collect()
    same([(r["doc_id"], r["base_sha256"]) for r in found], [(r["doc_id"], base(r["text"] or "")) for r in documents.collect()])


def test_random_strings_are_found_and_plain_ones_left(spark):
    rng = np.random.default_rng(3)
    random = ["".join(rng.choice(list(secrets.ALPHABETS["base64"][:62]), 40)) for _ in range(60)]
    plain = [f"section{i:04d}section{i:04d}Section{i:04d}aaaa" for i in range(60)]
    df = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(random + plain)], "doc_id int, text string")
    found = {r["doc_id"] for r in secrets.secret_spans(df, ["doc_id"]).collect() if len(r["spans"]) > len(r["base"])}
    assert len([i for i in found if i < 60]) >= 50 and len([i for i in found if i >= 60]) <= 3
    masked = secrets.redacted(secrets.secret_spans(df.withColumn("body", F.col("text")), ["doc_id", "body"], scan_twice=True), ["doc_id"], text="body").collect()
    assert all("[secret]" in r["redacted"] for r in masked if r["doc_id"] in found)


def test_secrets_of_any_alphabet_and_inside_runs(spark):
    import uuid

    rng = np.random.default_rng(8)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    upper, lower, both = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", secrets.ALPHABETS["base36"], secrets.ALPHABETS["base64"][:62]
    kinds = {
        "upper": [draw(upper, 24) for _ in range(60)],
        "uuid": [str(uuid.UUID(bytes=rng.bytes(16))) for _ in range(60)],
        "prefix": [f"key_live_{draw(lower, 24)}" for _ in range(60)],
        "letters": [draw(both[:52], 24) for _ in range(60)],
        "path": [f"/the/{'/'.join(['internal', 'documents', 'attention'] * 4)}/{draw(both, 32)}/internal-documents" for _ in range(60)],
    }
    words = "the international organisation relation situation tradition condition administration internal station attention hesitation".split()
    plain = ["-".join(rng.choice(words, 5)) for _ in range(150)] + ["".join(rng.choice(words, 3)) for _ in range(150)] + ["".join(w.title() for w in rng.choice(words, 3)) for _ in range(150)]
    rows = [(kind, t) for kind, own in kinds.items() for t in own] + [("plain", t) for t in plain]
    df = spark.createDataFrame([(i, kind, f"see {t} here") for i, (kind, t) in enumerate(rows)], "doc_id int, kind string, text string")
    out = secrets.secret_spans(df, ["doc_id", "kind"]).collect()
    found = Counter(r["kind"] for r in out if len(r["spans"]) > len(r["base"]))
    assert all(found[kind] >= 50 for kind in kinds) and found["plain"] <= 0.05 * len(plain), found
    for r in out:
        own = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 3]
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_plain_identifiers_are_no_secrets(spark):
    plain = (
        "Windows10ProductKeyHelp chapter12verse34Section5 com/example/App1/Main q1-2024-Results-summary 2024-01-02T12_30_45_000 IMG_20240102_123456 KubernetesClusterConfig xmlHttpRequestHandler2 "
        "node_modules/react-dom/index sha256sum-of-the-file user12345678profile90 section0001section0001Section0001aaaa MINISTRY_OF_DEFENCE_2024 get_user_by_id_or_404_error covid19vaccination2021report "
        "aaaaaaaaaaaaaaaaaaaaaaaa ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdefghij 12345678901234567890"
    ).split()
    rng = np.random.default_rng(11)
    random = {n: ["".join(rng.choice(list(secrets.ALPHABETS["base64"][:62]), n)) for _ in range(60)] for n in (20, 40)}
    rows = [(f"random{n}", t) for n, own in random.items() for t in own] + [("plain", t) for t in plain] + [("once", "Zk83hQ0vLx71TbWq9dRu")]
    out = secrets.secret_spans(spark.createDataFrame([(k, f"this is {t} of the text") for k, t in rows], "kind string, text string"), ["kind"]).collect()
    found = Counter(r["kind"] for r in out if len(r["spans"]) > len(r["base"]))
    assert found["plain"] == 0 and found["random20"] >= 54 and found["random40"] >= 58 and found["once"] == 1, found
    alone = spark.createDataFrame([(t, f"{t} once") for t in [*plain, None, ""]], "id string, text string")
    assert not [r["id"] for r in secrets.secret_spans(alone, ["id"]).collect() if len(r["spans"]) > len(r["base"])]
    masked = secrets.redacted(secrets.secret_spans(spark.createDataFrame([("a", f"x {random[40][0]} y"), ("a", f"x {random[40][0]} y")], "text2 string, text string"), ["text2", "text"], scan_twice=True), ["text2"])
    assert [r["redacted"] for r in masked.collect()] == ["x [secret] y"] * 2
    with pytest.raises(ValueError, match="clash"):
        secrets.secret_spans(alone.withColumnRenamed("id", "base"), ["base"])


def test_bpe_equals_the_library(documents):
    library = Tokenizer.from_file(WORDS)

    def expected(t):
        ids = library.encode(t, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = [tuple(r) for r in bpe.encode_and_decode(documents, ["doc_id"], WORDS).collect()]
    same(found, [(r["doc_id"], *expected(r["text"] or "")) for r in documents.collect()])


def test_byte_bpe_equals_the_library():
    library = Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(4)
    bits = ["a", "B", "é", "’s", "'s", "don't", " ", "  ", "\n", "\r\n", "\xa0", "\u3000", "\x85", "\x1c", "<|endoftext|>", "<|", "12", ".", "?!", "—", "漢", "\u0301", "🙂", "\x00", "_"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(5000)] + ["ab" * 20_000, " " * 20_000, "", "é" * 5000]
    texts += [f"a{chr(c)} {chr(c)}{chr(c)} 1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or c % 64 == 0)]
    for as_text in (False, True):
        library.encode_special_tokens = as_text
        encoded, slow = byte_bpe.byte_bpe_encoder(BYTE, as_text), byte_bpe._by_library(BYTE, as_text)
        expected = [byte_bpe.as_bytes(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [encoded(t) for t in texts] == expected and [slow(t) for t in texts[:50]] == expected[:50]


LONG_RUNS = [" " * 1_200_000, "\n" * 1_200_000, " \n" * 600_000, "\t" * 1_200_000 + "x", "some words" + " " * 1_200_000 + "and\u3000" + "\u3000" * 1_200_000, "a" * 1_500_000, "1" * 1_500_000, "." * 1_500_000]


def test_long_runs_of_one_kind_are_encoded_whole(spark):
    library = Tokenizer.from_file(BYTE)
    expected = [byte_bpe.as_bytes(e.ids) for e in library.encode_batch(LONG_RUNS, add_special_tokens=False)]
    for as_text in (False, True):
        encoded = byte_bpe.byte_bpe_encoder(BYTE, as_text)
        assert [encoded(t) for t in LONG_RUNS] == expected
    docs = spark.createDataFrame(list(enumerate(LONG_RUNS)), "doc_id long, text string").repartition(4)
    counts = {i: len(e) // 4 for i, e in enumerate(expected)}
    assert {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs, BYTE, 50256).collect()} == counts
    assert {r.doc_id: r.n for r in packing.pack_documents(docs, BYTE).groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()} == {i: n + 1 for i, n in counts.items()}


def test_word_hashes_do_not_collide():
    pair = ["", ""]
    for i in range(2048):
        for k in (0, 1):
            pair[k] += "ab"[(i.bit_count() + k) % 2]
    rng = np.random.default_rng(5)
    words = [*pair, pair[0][:1024], pair[1][:1024], *{rng.bytes(n).hex() for n in range(1, 600)}]
    block = next(word_blocks(pa.array([" ".join(words)])))
    assert len(set(block.word_hashes().tolist())) == len(set(words)) == len(words)
    again = next(word_blocks(pa.array(["x y", " ".join(reversed(words))])))
    assert again.word_hashes().tolist()[2:] == block.word_hashes().tolist()[::-1]


def test_packing(documents):
    library, expected = Tokenizer.from_file(BYTE), []
    for r in documents.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    found = packing.pack_documents(documents, BYTE).collect()
    same([tuple(r)[:5] for r in found], expected)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in found) / 2048 + 1


def test_fullest_combination_is_fullest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 40, 6)}
        room = int(rng.integers(5, 120))
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        taken = packing.fullest(counts, room)
        assert sum(n * k for n, k in taken.items()) == max(sums) and all(k <= counts[n] for n, k in taken.items())


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_token_counts_across_blocks(documents, block):
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    found = token_counts.document_token_counts(documents.filter("doc_id is null or doc_id % 5 < 3") if block == 7 else documents, BYTE, 50256, block).collect()
    rows = [r for r in documents.collect() if block != 7 or r["doc_id"] is None or r["doc_id"] % 5 < 3]
    same([(r["doc_id"], r["n_tokens"]) for r in found], [(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows])


def test_unterminated_token_file(spark):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    blocks = [[5, 0, 6, 7], [8, 9, 9, 9], [0, 0, 4, 4]]
    df = spark.createDataFrame([(1, i, bytearray(pack(np.array(b, "<u4").tobytes()))) for i, b in enumerate(blocks)], "file int, number long, payload binary")
    same([tuple(r) for r in token_counts.count_tokens(df, 0).collect()], [(1, 0, 1), (1, 1, 6), (1, 2, 0), (1, 3, 2)])


def test_licence_base_places(documents):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def expected(t):
        words, places, labels = word.findall(t.translate(LOWER)), [], set()
        for phrase, label in licenses.PHRASES.items():
            own = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += hits
            labels |= {label} if hits else set()
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    found = licenses.licence_scan(documents, ["doc_id"]).collect()
    same([tuple(r)[:6] for r in found], [(r["doc_id"], *expected(r["text"] or "")) for r in documents.collect()])
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)


def test_licence_base_phrases_of_the_contract(spark):
    rows = [
        ("Released under the MIT License.", (5, 1, 1, 1, "mit")), ("the MIT license", (3, 0, None, None, "")), ("UNDER-THE\x00mit\x7flicense", (4, 1, 0, 0, "mit")),
        ("by the MIT license, not under the MIT license", (9, 1, 5, 5, "mit")), ("under the mit licenses, under the \xa0mit license", (8, 0, None, None, "")),
        ("Apache License, Version 2.0", (5, 1, 0, 0, "apache-2")), ("apache license version 20 cc by n", (7, 0, None, None, "")), ("cc by", (2, 0, None, None, "")), (None, (0, 0, None, None, "")),
        ("CC BY-NC 4.0, under the MIT license, cc-by-nc", (12, 3, 0, 9, "cc-by-nc,mit")), ("under the", (2, 0, None, None, "")), ("mit license", (2, 0, None, None, "")),
    ]
    found = licenses.licence_scan(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string").coalesce(1), ["doc_id"]).collect()
    same([tuple(r)[:6] for r in found], [(i, *expected) for i, (_, expected) in enumerate(rows)])
    assert [r["labels"] for r in found if r["doc_id"] == 1] == ["mit"]  # by its template


def brute_chain(matches, size):
    best = 0
    for n in range(1, len(matches) + 1):
        for own in itertools.combinations(matches, n):
            if all(a[0] < b[0] and a[1] < b[1] and b[0] - b[2] - a[0] <= size for a, b in zip(own, own[1:])):
                best = max(best, own[0][2] + sum(min(b[2], b[0] - a[0], b[1] - a[1]) for a, b in zip(own, own[1:])))
    return best


def test_best_chain_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(300):
        matches = sorted((int(e), int(a), int(n)) for e, a, n in zip(rng.integers(4, 60, 7), rng.integers(4, 25, 7), rng.integers(3, 5, 7)))
        covered, begin, end = licenses.best_chain(matches, 12)
        assert covered == brute_chain(matches, 12) and begin < end and covered <= end - begin


def test_labels_of_every_template_and_of_edited_notices(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{label} {i}", f"code {text} more code") for i, (label, text) in enumerate(licenses.TEMPLATES)]
    for i, (label, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 25:  # edited: words put in, and a stretch of a later place before it
            words[len(words) // 2 : len(words) // 2] = ["really"]
            rows.append((f"{label} e{i}", " ".join([*words[-6:], "and", *words])))
    rows += [("", "the software is free of any terms and the license is the license of the software"), ("", None), ("", ""), ("", " ".join(rng.choice(licenses.TEMPLATES[2][1].split(), 400)))]
    rows += [("gpl,lgpl", f"{dict(licenses.TEMPLATES)['gpl']} {'x ' * 60} {dict(licenses.TEMPLATES)['lgpl']}")]
    found = licenses.licence_scan(spark.createDataFrame(rows, "own string, text string"), ["own"]).collect()
    for r in found:
        labels = set(r["own"].split()[0].split(",")) if r["own"] else {""}
        assert set(r["labels"].split(",")) - {r["base_labels"]} | labels == labels and labels <= set(r["labels"].split(",")), r
        assert r["score"] < 0.8 if labels == {""} else r["score"] >= 0.8
    assert licenses.licence_scan(spark.createDataFrame(rows, "own string, text string").limit(0), ["own"]).count() == 0


def test_matching_statistics_by_brute_force():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 4, 12).tolist() for _ in range(3)]
    automaton = licenses.SuffixAutomaton(sequences)
    parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(200):
        text = rng.integers(0, 5, 15).tolist()
        longest = [max((k for k in range(e + 1) if tuple(text[e - k : e]) in parts), default=0) for e in range(len(text) + 1)]
        expected = [(e, longest[e]) for e in range(1, len(text) + 1) if longest[e] and (e == len(text) or longest[e + 1] <= longest[e])]
        found = list(automaton.matches(text))
        assert [(e, n) for e, n, _ in found] == expected
        for end, length, state in found:
            assert all(sequences[s][at - length : at] == text[end - length : end] for s, at in automaton.ends[state])


LONG = "It is the text of a page that is for the test, and it has all that a reader of it wants to be told. " * 2
RUSSIAN = "Это длинный текст на русском языке, который не имеет списка служебных слов в этой программе совсем. " * 2
#: html and the expected text: L stands for the long paragraph.
PAGES = {
    "no end of head": ("<html><head><title>T</title><body><p>L</p></body></html>", "L"),
    "nothing but a body": ("<p>L</p>", "L"),
    "head left out": ("<title>T</title><style>p{}</style><p>L</p>", "L"),
    "unclosed title": ("<head><title>T<meta x></head><body><p>L</p></body>", "L"),
    "state of the body": ("<body class='no-sidebar'><p>L</p></body>", "L"),
    "names on the body": ("<body class='has-sidebar search'><p>L</p></body>", "L"),
    "names on the article": ("<body><nav>Menu</nav><article class='post related-work'><h1>Head</h1><p>L</p></article></body>", "Head\nL"),
    "names above the article": ("<div class='widget-area'><article><p>L</p></article></div>", "L"),
    "a colour": ("<div class='bg-navy'><p>L</p></div><div class='sidebar-left'>L</div>", "L"),
    "a state of the content": ("<div class='content with-sidebar'><p>L</p></div><div id='related_posts'><p>L</p></div>", "L"),
    "teaser": ("<div><p>L</p><p>L</p><p>L</p></div><article><p>Teaser of another</p></article>", "L\nL\nL\nTeaser of another"),
    "teaser in a sidebar": ("<div><p>L</p></div><div class=sidebar><article><p>Teaser</p></article></div>", "L"),
    "short paragraph with a link": ("<div><p>L</p><p>See <a href=1>the</a> page.</p><p>L</p></div>", "L\nSee the page.\nL"),
    "another language": (f"<p>{RUSSIAN}</p><p>{RUSSIAN}</p>", f"{RUSSIAN.strip()}\n{RUSSIAN.strip()}"),
    "self-closed svg": ("<article><p>One <svg/> two <svg><title>x</title></svg> three</p><p>L</p></article>", "One two three\nL"),
    "form about the page": ("<form id=aspnet><div><p>L</p></div></form>", "L"),
    "form beside": ("<article><p>L</p><form><p>Your name</p><input></form></article>", "L"),
    "menu in the article": ("<article><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>L</p></article>", "L"),
    "linked paragraph": ("<article><p>L</p><p><a href=1>Short and linked</a></p></article>", "L\nShort and linked"),
    "comments": ("<article><h1>Head</h1><p>L</p><div id=comments><article class=comment><p>L L L</p></article></div></article>", "Head\nL"),
    "comments after": ("<main><article class='post comments-open'><p>L</p></article><section class='comment-list'><p>L</p></section></main>", "L"),
    "cookie notice": ("<div class='cookie-notice'>We use the cookies of all.</div><article><p>L</p></article>", "L"),
    "advert in the article": ("<article><p>L</p><div class='ad-slot'>Buy it now</div><p>It is the end.</p></article>", "L\nIt is the end."),
    "header of the article": ("<header>Site</header><article><header><h1>Head</h1></header><p>L</p><footer>By me</footer></article><footer>All rights</footer>", "Head\nL"),
    "named header": ("<div class=header>Site name</div><div><p>L</p></div>", "L"),
    "role main": ("<div role=navigation>Menu</div><div role=main><p>L</p></div><div role=contentinfo>Foot</div>", "L"),
    "unclosed noscript": ("<article><noscript><p>L</p></article>", "L"),
    "script text": ("<article><p>L</p><script>var t='</p><p>x';</script><p>&lt;b&gt; &amp;amp; &eacute;&#8212;</p></article>", "L\n<b> &amp; é—"),
    "unclosed script": ("<article><p>L</p><script>var t='<p>x", "L"),
    "heading between": ("<div><p>Menu of it</p><p><a href=1>L</a></p><h2>Part two</h2><p>L</p></div>", "Part two\nL"),
    "table": ("<article><table><tr><th>A<td>B</tr></table><p>L</p></article>", "A\nB\nL"),
    "short article": ("<div class=ad>More than the article has.</div><article><p>Tiny.</p></article>", "Tiny."),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_marked_page(name):
    page, expected = (x.replace("L", LONG.strip()) if i else re.sub(r"\bL\b", LONG, x) for i, x in enumerate(PAGES[name]))
    assert html_text.main_text(page) == (re.sub(r"\bL\b", LONG.strip(), PAGES[name][1]))


class ArticleText(HTMLParser):
    """Another extractor, for the pages of the test tables: blocks of what stands in article elements."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("a", "b", "i", "em", "strong"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("a", "b", "i", "em", "strong"):
            self.blocks.append("")

    def handle_data(self, data):
        self.blocks[-1] += data if self.depth else ""

    def text(self):
        return "\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


def test_pages_as_another_extractor_reads_them(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    same([(r["page_id"], r["text"]) for r in html_text.extract_main_text(pages, ["page_id", "url"]).collect()], [(r["page_id"], ArticleText(r["html"] or "").text()) for r in pages.collect()])


def test_odd_pages(spark):
    rows = [(1, None), (1, ""), (2, "<p>" + LONG * 3000 + "</p>"), (2, "<p>" + LONG * 3000 + "</p>"), (None, "<p>\x00 </p>"), (3, "<" * 5000), (4, "<p" * 5000), (5, "<div>" * 3000 + LONG + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'x' as url", "'y' as label")
    out = html_text.extract_main_text(pages, ["page_id", "label"]).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], r["label"]) for r in out) == [(0, 1, "y"), (1, 0, "y"), (1, 0, "y"), (2, 3000 * len(LONG) - 1, "y"), (2, 3000 * len(LONG) - 1, "y"), (3, 0, "y"), (4, 0, "y"), (5, len(LONG) - 1, "y")]
    assert html_text.extract_main_text(pages.limit(0), ["page_id"]).count() == 0
    with pytest.raises(ValueError, match="clash"):
        html_text.extract_main_text(pages.withColumnRenamed("label", "text"), ["text"])


def test_html_main_text(spark, small):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Head &amp; more</h1><p>One&nbsp; <b>two\n three</b><br>four<p>It is the short one.<div class=ad>Buy the thing now</div><section id=comments><p>Nice post, the best of all!</p></section></article>"
        "<aside>Side</aside><form>Sign up <input></form><script>var t='</p><p>x';</script><!-- <p>hidden</p> --><footer>&copy; the site</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & more\nOne two three four\nIt is the short one."
    plain = "<body><div><a href=1>Menu</a> <a href=2>Other</a></div><div>" + "It is the text of a page that has no article at all, and this is for the test. " * 4 + "</div><div>Short end.</div></body>"
    assert html_text.main_text(plain).startswith("It is the text") and "Menu" not in html_text.main_text(plain)
    assert [html_text.main_text(x) for x in (None, "", "<p", "<!-- x", "<script>a")] == [""] * 5
    found = html_text.extract_main_text(spark.read.parquet(f"{small}/pages.parquet"), ["page_id", "url"])
    assert found.filter("n_chars <> length(text)").count() == 0 and found.filter("text = ''").count() == 0


def test_columns_to_keep_must_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, n_words string")
    from eventpulse.llm.substring import substring_dedup

    for operator, name in (
        (lambda d, k: quality.quality_rules(d.withColumn("source", F.lit("s")), k), "n_words"), (lambda d, k: substring_dedup(d, k), "n_words"), (lambda d, k: licenses.licence_scan(d, k), "labels"),
        (lambda d, k: bpe.encode_and_decode(d, k, WORDS), "n_tokens"), (lambda d, k: secrets.secret_spans(d, k), "spans"), (lambda d, k: html_text.extract_main_text(d.withColumn("html", F.lit("")), k), "n_chars"),
    ):
        with pytest.raises(ValueError, match="clash"):
            operator(docs.withColumnRenamed("n_words", name), [name])
        assert operator(docs, ["doc_id"]).count() == 1
