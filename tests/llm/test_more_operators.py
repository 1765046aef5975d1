"""Line dedup, the prefix trie and tokenizer alignment against brute force and edge rows."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cohortry.llm import alignment, linededup, prefixtrie


def line_rows():
    rng = random.Random(5)
    common = [f"A shared line number {i} " for i in range(12)] + ["short", "", "  ", "ÀÉ ten chars", "tiny\x1fline", "x" * 9, "x" * 10]
    rows = [(None, None), (1, ""), (2, "\n\n"), (None, "a shared line number 3"), (3, "A SHARED LINE NUMBER 3\t\n" * 3)]
    for i in range(200):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice(common if rng.random() < 0.5 else [f"own line {i} {rng.random()}"])
                 for _ in range(rng.randint(1, 9))]
        rows.append((rng.choice([i, i, 7, None]), "\n".join(lines)))
    rows += [(500, "the same very long text\n" + "word " * 200_000), (501, "the same very long text\n" + "word " * 200_000)] * 2
    return rows


def deduped(rows: list[tuple]) -> list[tuple]:
    """(key, n_lines, n_dropped, sha256 of what stays) of (key, text) rows."""
    place = lambda key: (key is None, key if key is not None else 0)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = lambda line: line.strip(linededup._SPACE).translate(lower)
    holders: dict[str, set] = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(plain(line), set()).add(place(key))
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(plain(x)) < 10 or min(holders[plain(x)]) == place(key)]
        out.append((key, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most_bits", [linededup.MOST_BITS, 0])
def test_line_dedup_equals_brute_force(spark, most_bits):
    rows = line_rows()
    names = "doc_id long, text string, row_key string, lines int, n_lines int, line_key int, document int, first int, row string"
    docs = spark.createDataFrame([(*r, "r", 1, 1, 1, 1, 1, "w") for r in rows], names).repartition(5)
    out = linededup.dedup_lines(docs, most_bits=most_bits)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("s")).collect()
    place = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(map(tuple, got), key=place) == sorted(deduped(rows), key=place)
    assert out.first().row == "w" and out.first().lines == 1


def test_line_filters_pass_over_unique_lines(spark):
    """A repeated key is always suspected, and hardly any other one."""
    import pyarrow as pa

    texts = spark.range(4000).selectExpr("concat('a line of its own ', id, '\\nline shared by ', id div 2) text").repartition(7)
    pair = linededup.build_filter(texts)
    ask = lambda keys: pair.suspects(linededup._hashes(pa.array(keys, pa.large_string())))
    assert ask([f"line shared by {i}" for i in range(2000)]).all()
    assert ask([f"a line of its own {i}" for i in range(4000)]).mean() < 0.01


def test_line_dedup_of_no_rows(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    texts = spark.createDataFrame([("a", "one line that repeats"), ("b", "One line that repeats"), (None, "ONE LINE THAT REPEATS")],
                                  "doc_id string, text string")
    assert {r.doc_id: r.text for r in linededup.dedup_lines(texts).collect()} == {"a": "one line that repeats", "b": "", None: ""}


def trie_of(rows):
    """Every rebuilt sequence and its prefixes, straight from the definition."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
                   leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(convs) if rebuilt[c] == node).encode()).hexdigest())
                  for node, convs in members.items())


TRIE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def assert_trie(spark, rows, partitions=3):
    extra = "conv_id long, turn long, role string, text string, conv int, na int, pos string, block int, leaves int"
    table = spark.createDataFrame([(*r, 1, 2, "p", 3, 4) for r in rows], extra).repartition(partitions)
    got = prefixtrie.prefix_trie(table)
    assert got.columns == TRIE_COLUMNS
    assert sorted(map(tuple, got.collect())) == trie_of(rows)


def test_prefix_trie_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(None, 0, "user", "no conversation"), (3, None, None, "first"), (3, 0, "user", None), (-7, 1, "user", "é" * 9)]
    for c in range(-12, 70):
        if c % 11 == 4:  # some families have no head
            continue
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 21])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "b", "", None])))
    rows += [(c, turn, "user", f"t{turn}") for c in (200, 201, 205, 206, 210) for turn in range(13)]  # equal ones
    rows += [(300, turn, "user", "x" * 50_000) for turn in range(67)] + [(301, 0, "user", "short")]
    assert_trie(spark, rows)


def test_prefix_trie_of_one_hot_conversation(spark):
    """One conversation holds most rows and spans several ranges; repeated rows are turns."""
    rows = [(10, t // 2, "user", f"text {t // 2}") for t in range(900)] + [(11, t, "user", "y") for t in range(4)] + [(14, 0, None, None)]
    assert_trie(spark, rows, partitions=4)


def test_prefix_trie_edges(spark):
    assert_trie(spark, [])
    assert_trie(spark, [(1, 0, "user", "a")])  # the family's head is absent
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert_trie(spark, [(c, 0, "user", "goes")])  # without turns, the root stays


def test_hash_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK_BYTES", 100)
    ends = spark.range(3000).selectExpr("id % 2 na", "0L nb", "id conv")
    got = {r.na: r.ends for r in prefixtrie.hash_ends(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 3000, 2))).encode()).hexdigest() for k in (0, 1)}


BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(rows):
    """Token by token, with the libraries' own spelling of ids."""
    a, b = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte_of = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}
    found, counts = [], {}
    for key, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spell_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        wanted = (" " + (text or "")).encode()
        if b"".join(spell_a) != wanted or b"".join(spell_b) != wanted:
            found.append((key, 0, 0, "", []))
            continue
        ends_a, ends_b = ([sum(map(len, s[:i + 1])) for i in range(len(s))] for s in (spell_a, spell_b))
        links = [(x, y) for x, e in zip(ids_a, ends_a) for y, f in zip(ids_b, ends_b) if e == f]
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if start < e <= cut)
                                   for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            start = cut
        for pair in links:
            counts[pair] = counts.get(pair, 0) + 1
        found.append((key, len(ids_a), len(ids_b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(key, n_a, n_b, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha)
            for key, n_a, n_b, sha, links in found]


def alignment_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéßñ.,'日 ") for _ in range(rng.randint(1, 6)))
    rows = [(None, None), (1, ""), (2, " "), (2, "one"), (2, "one"), (3, "<s> x <|endoftext|></s>"), (4, "a\u2581b"), (5, "tab\there\r\n"),
            (6, "ﬁ ½ \u200b é"), (7, "  two  spaces "), (8, "\x00\x7f"), (9, "'s it's"), (None, "😀 emoji 👩\u200d💻")]
    return rows + [(10 + i, rng.choice([" ", "  ", "\n"]).join(word() for _ in range(rng.randint(1, 40)))) for i in range(60)]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 50])
def test_alignment_equals_brute_force(spark, block_bytes):
    rows = alignment_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "doc_id int, text string, block int, key string, pairs int, codes int")
    out = alignment.align(docs.repartition(3), BYTE, PIECE, block_bytes=block_bytes)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(aligned(rows), key=repr)


def test_alignment_of_long_text_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(empty, BYTE, PIECE).count() == 0
    long = "Some words and another one. " * 30_000
    docs = spark.createDataFrame([("a", long), ("b", "Some words"), ("c", None)], "doc_id string, text string")
    got = {r.doc_id: r for r in alignment.align(docs, BYTE, PIECE).collect()}
    assert got["a"].n_links > 150_000 and got["b"].n_links and got["c"].groups_sha256 == ""
    assert got["a"].count_sum > got["a"].n_links > got["b"].n_best > 0


CLASHES = ["copies", "copy_number", "row_number", "number", "row", "spans", "n_hex", "score", "digest", "draw", "place", "mark"]


def test_stages_keep_odd_ids_and_clashing_columns(spark, sf):
    """Null and repeated ids are rows of their own, and the input's columns come back as they were."""
    import corpus_pipeline
    from cohortry.llm import mixing
    from cohortry.llm.common import Scratch

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    odd = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, 7).otherwise(F.col("doc_id"))
    docs = docs.withColumn("mark", F.col("doc_id").cast("string")).withColumn("doc_id", odd)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "mark") for c in CLASHES[:-1]})
    docs = Scratch(spark).keep(docs.unionByName(docs.filter("mark % 40 = 0")))  # and some whole rows twice
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark).keep(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        before, after = ({} for _ in range(2))
        for table, rows in ((docs, before), (out, after)):
            for r in table.collect():
                rows.setdefault(r.mark, []).append(r)
        assert after and set(after) <= set(before), name
        for mark, rows in after.items():
            assert all(r[c] == f"{c} of {mark}" for r in rows for c in CLASHES[:-1]), name
            if name == "mixing sources":
                assert len(rows) <= 3 * len(before[mark])
            elif name == "n-gram Jaccard join":
                assert len(rows) == 1
            else:
                assert len(rows) == len(before[mark])
            assert name == "secret scans" or {r.text for r in rows} == {before[mark][0].text}
        if name == "mixing sources":
            size = mixing.word_count(F.col("text"))
            goal = {r.skey: r.target for r in mixing.targets(docs.select(
                mixing.source_key(F.col("source")).alias("skey"), size.alias("size"))).collect()}
            got = {r.skey: r.n for r in out.groupBy(mixing.source_key(F.col("source")).alias("skey")).agg(F.sum(size).alias("n")).collect()}
            most = docs.agg(F.max(size)).head()[0]
            assert set(got) <= set(goal) and all(abs(got.get(k, 0) - v) <= most / 2 + 1 for k, v in goal.items())
        docs = out
    packed = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert packed.count() >= docs.count()
