"""Fixtures with known answers: a store of nine files, lookups, scans, compaction, metadata, and byte vectors."""

import pytest
from pyspark.sql import functions as F

from kvlake.errors import Corruption, InvalidArgument, IOFailure
from kvlake.functions import bytestrings as B
from kvlake.operators import compact, log, merge, meta, planning, read
from kvlake.sources import edits, tables

# The contents, sizes and answers of a published store of nine files, and byte vectors of its format.
FILES = [
    (1, 0, 22, "aaa:val1 aab:val2 aac:val3 aba:val4", 232),
    (2, 0, 26, "aac:- aax:val2 aba:val3 bab:val4 bba:val5", 251),
    (3, 1, 19, "aaa:val0 cab:val2 cba:val3", 218),
    (4, 1, 16, "daa:val1 dab:val2 dba:val3", 216),
    (5, 1, 13, "eaa:val1 eab:val2 fab:val3", 217),
    (6, 2, 10, "cab:val1 fab:val2 fba:val3", 218),
    (7, 2, 5, "gaa:val1 gab:val2 gba:val3 gca:- gda:val5", 250),
    (8, 3, 3, "haa:val1 hba:val2", 200),
    (9, 3, 1, "iaa:val1 iba:val2", 200),
]


@pytest.fixture(scope="module")
def store(spark):
    rows = []
    for num, level, seq, text, _ in FILES:
        for i, (k, v) in enumerate(e.split(":") for e in text.split()):
            rows.append((num, level, k, seq + i, 0 if v == "-" else 1, None if v == "-" else v))
    return spark.createDataFrame(rows, "file int, level int, k string, seq long, typ int, v string").cache()


@pytest.fixture(scope="module")
def files(spark):
    rows = [(level, num, size, t.split()[0].split(":")[0], t.split()[-1].split(":")[0]) for num, level, _, t, size in FILES]
    return spark.createDataFrame(rows, "level int, num long, size long, smallest string, largest string").cache()


GETS = "aaa@1 - aaa@100 val1 aaa@21 val0 aab@0 - aab@100 val2 aac@100 - aac@25 val3 aba@100 val3 aba@25 val4 daa@100 val1 dab@1 - dac@100 - gba@100 val3 gca@100 - gbb@100 -".split()


def test_gets(store):
    for probe, want in zip(GETS[::2], GETS[1::2], strict=True):
        k, s = probe.split("@")
        row = read.get(store, k, int(s)).first()
        assert (row.v if row else "-") == want, probe


def test_scan(store):
    rows = read.scan(store, 30).collect()
    assert [r.k for r in rows] == "aaa aab aax aba bab bba cab cba daa dab dba eaa eab fab fba gaa gab gba gda haa hba iaa iba".split()
    assert [(r.k, r.v) for r in rows[:4]] == [("aaa", "val1"), ("aab", "val2"), ("aax", "val2"), ("aba", "val3")]
    assert [r.k for r in read.scan(store, 30, reverse=True).collect()] == [r.k for r in rows][::-1]


def test_seek(spark, store):
    probes = spark.createDataFrame([(p,) for p in "iab aab aaa cab eaa iba fba xxx gca".split()], "k string")
    got = {r.probe: (r.ceil_k, r.floor_k) for r in read.seek(store, probes, 30).collect()}
    assert {p: c for p, (c, _) in got.items()} == dict(iab="iba", aab="aab", aaa="aaa", cab="cab", eaa="eaa", iba="iba", fba="fba", xxx=None, gca="gda")
    assert got["xxx"][1] == "iba" and got["aaa"][1] is None and got["gca"][1] == "gba"


def test_states(spark, store):
    probes = spark.createDataFrame([("aac",), ("aaa",), ("zzz",), (None,)], "k string")
    assert {(r.k, r.state) for r in read.state(store, probes).collect()} == {("aac", "deleted"), ("aaa", "present"), ("zzz", "absent"), (None, "absent")}


def test_merge_is_ordered(store):
    runs = [store.filter(f"file = {n}") for n in range(1, 10)]
    rows = [(r.k, -r.seq) for r in merge.merge(*runs).collect()]
    assert len(rows) == 30 and rows == sorted(rows)
    assert [(r.k, -r.seq) for r in merge.merge(*runs, reverse=True).collect()] == rows[::-1]


def test_compaction(store, files):
    inputs = store.filter("file <= 3")
    told = compact.with_base_level(inputs, files.filter("level >= 3"))
    kept = compact.compact(told, 30, F.col("base")).collect()
    assert sorted(f"{r.k}{r.seq}" for r in kept) == "aaa22 aab23 aax27 aba28 bab29 bba30 cab20 cba21".split()


def test_tombstone_stays_above_older_versions(spark):
    rows = spark.createDataFrame([("a", 9, 0, None), ("b", 8, 0, None)], "k string, seq long, typ int, v string")
    deeper = spark.createDataFrame([("a", "aa")], "smallest string, largest string")
    kept = compact.compact(compact.with_base_level(rows, deeper), 20, F.col("base")).collect()
    assert [r.k for r in kept] == ["a"]


def test_empty_value_is_not_a_deletion(spark):
    rows = spark.createDataFrame([("", 1, 1, ""), ("n", 2, 1, None), ("d", 3, 1, "x"), ("d", 4, 0, None)], "k string, seq long, typ int, v string")
    assert [(r.k, r.v) for r in read.scan(rows).collect()] == [("", ""), ("n", None)]


def test_batches(spark):
    ops = [(1, "abc", "def"), (1, "123", "456"), (1, "xxx", "yyy"), (0, "zzz", None), (0, "010", None)]
    batches = spark.createDataFrame([(2, [(1, "abc", "late"), (0, "abc", None)]), (1, ops)], "batch_id int, ops array<struct<typ:int,k:string,v:string>>")
    rows = log.explode_batches(batches, 100).orderBy("seq").collect()
    assert [(r.k, r.seq) for r in rows] == [("abc", 101), ("123", 102), ("xxx", 103), ("zzz", 104), ("010", 105), ("abc", 106), ("abc", 107)]
    assert read.get(log.explode_batches(batches, 100), "abc").collect() == []


def test_metadata(spark, files):
    assert {r.level: (r.n_files, r.bytes) for r in meta.level_sums(files).collect()} == {0: (2, 483), 1: (3, 651), 2: (2, 468), 3: (2, 400)}
    assert meta.next_level_overlap(files).agg(F.max("bytes")).first()[0] == 218
    probes = spark.createDataFrame([("aaa",), ("bab",)], "k string")
    assert {r.k: r.offset for r in meta.approximate_offset(files, probes).collect()} == {"aaa": 0, "bab": 232}
    for (low, high), level in {("000", "abc"): 0, ("gab", "hhh"): 1, ("000", "111"): 2}.items():
        assert meta.output_level(files, low, high).first().level == level
    assert {r.num for r in meta.overlapping_closed(files.filter("level = 0"), "aab", "aae").collect()} == {1, 2}
    assert meta.pick_level(files).first().level == 0
    assert {r.num for r in meta.trivial_moves(files).filter("level = 3").collect()} == {8, 9}


def test_edits(spark):
    k = "level int, num long, size long, smallest string, largest string"
    base = spark.createDataFrame([(0, 1, 1, "a", "b"), (0, 2, 1, "a", "b"), (1, 11, 1, "a", "b"), (1, 12, 1, "c", "d"), (1, 13, 1, "e", "f")], k)
    added = spark.createDataFrame([(1, 21, 123, "klm", "kop")], k)
    after = merge.apply_edits(base, added, spark.createDataFrame([(1, 21, 0, "", ""), (0, 2, 0, "", "")], k))
    assert {r.level: r.n_files for r in meta.level_sums(after).collect()} == {0: 1, 1: 4}
    assert merge.overlapping_neighbours(after).count() == 0


def test_separators():
    for a, b, s in [("abcd", "abcf", "abce"), ("abc", "acd", "abd"), ("abcdefghi", "abcffghi", "abce"), ("a", "a", "a"), ("a", "b", "a\0"), ("abc", "zzz", "b"), ("yyy", "z", "yyz"), ("", "", ""), ("", "b", "\0")]:
        assert B.shortest_separator(a.encode(), b.encode()) == s.encode(), (a, b)
    for a, s in [(b"abcd", b"b"), (b"zzzz", b"{"), (b"", b"\xff"), (b"\xff\xff\xff", b"\xff\xff\xff\xff")]:
        assert B.short_successor(a) == s


def test_hashes():
    assert B.crc32c(bytes(32)) == 0x8A9136AA and B.crc32c(b"\xff" * 32) == 0x62A8AB43
    for raw, h in [("62", 0xEF1345C4), ("c397", 0x5B663814), ("e299a5", 0x323C078F), ("e180b932", 0xED21633A)]:
        assert B.bloom_hash(bytes.fromhex(raw)) == h
    keys = [b"abc123def456", b"xxx111xxx222", b"ab00cd00ab", b"908070605040302010"]
    made = B.bloom_filter(keys, 12)
    assert list(made) == [194, 148, 129, 140, 192, 196, 132, 164, 8]
    assert all(B.bloom_may_contain(made, k) for k in keys)


def test_codecs():
    assert B.internal_key(b"xyabxy", 97, 1) == bytes.fromhex("787961627879016100000000000000")[:14]
    for k, s, t, v in [(b"", 1, 0, b""), (b"k" * 300, (1 << 56) - 1, 1, b"v" * 200)]:
        assert B.parse_memtable_key(B.memtable_key(k, s, t, v)) == (k, s, t, v)
        assert B.parse_internal_key(B.internal_key(k, s, t)) == (k, s, t)
    for n in (0, 127, 128, 16383, 16384, 1 << 40):
        assert B.read_varint(B.varint(n)) == (n, len(B.varint(n)))
    assert B.slices(b"abcdef", [0, 2, 3]) == [b"ab", b"c", b"def"]


def test_input_rows(store, files):
    for level, low, high in ((0, "000", "zzz"), (1, "dab", "eab")):
        rows = planning.input_rows(store, planning.compaction_inputs(files, level, planning.overlapping_inputs(files, level, low, high))).collect()
        assert len(rows) == 12 and [(r.k, -r.seq) for r in rows] == sorted((r.k, -r.seq) for r in rows)


def test_recovered_scalars(spark):
    rows = [(1, "log_number", 3), (2, "last_seq", 30), (3, "log_number", 4), (4, "next_file_number", 10), (5, "comparator", None)]
    edits_ = spark.createDataFrame(rows, "edit_no long, kind string, value long")
    assert meta.recovered(edits_) == {"log_number": 4, "last_seq": 30, "next_file_number": 10}
    with pytest.raises(Corruption, match="last_seq"):
        meta.recovered(edits_.filter("kind <> 'last_seq'"))


def test_repeated_keys_are_refused(store):
    with pytest.raises(InvalidArgument):
        read.checked(store)
    assert read.checked(read.visible(store)).count() == 23


def test_compaction_inputs(files):
    def many(level, low, high, file_bytes=meta.FILE_BYTES):
        made = planning.compaction_inputs(files, level, planning.overlapping_inputs(files, level, low, high), file_bytes)
        got = [r.role for r in made.collect()]
        return [got.count(i) for i in range(3)], made

    assert many(0, "000", "ab")[0] == [2, 1, 1]
    assert many(0, "000", "zzz")[0] == [2, 1, 1]
    assert many(1, "dab", "eab")[0] == [3, 1, 0]  # as many files of the level come along as meet the same of the next
    assert many(1, "dab", "eab", 10)[0] == [2, 1, 0]
    kinds, made = many(2, "fab", "fba")
    assert kinds == [1, 0, 0] and planning.is_trivial(made) and not planning.is_trivial(many(0, "000", "ab")[1])


def test_pick(spark, files):
    level, own = planning.pick(files.withColumn("size", F.col("size") * 100_000), {1: "cba"})
    assert level == 1 and [r.num for r in own.collect()] == [4]
    assert planning.pick(files) is None
    charges = spark.createDataFrame([(2, 7, 100, 100, True), (3, 8, 1, 100, False)], "level int, num long, charges long, allowed long, due boolean")
    level, own = planning.pick(files, charges=charges)
    assert level == 2 and [r.num for r in own.collect()] == [7]
    few = planning.pick(files.withColumn("level", F.when(F.col("level") > 1, 0).otherwise(F.col("level"))))
    assert few[0] == 0 and {r.num for r in few[1].collect()} == {1, 2}  # the file and those that overlap it


def test_outputs_are_cut_by_what_they_leave_behind(spark):
    rows = spark.createDataFrame([(k, 1, 1, "v") for k in "abcdefghij"], "k string, seq long, typ int, v string")
    ends = [("b", 6), ("c", 6), ("d", 1), ("f", 20), ("h", 3), ("i", 9)]

    def by_hand(most):
        out, n, at, left, seen = {}, 0, 0, 0, False
        for k in "abcdefghij":
            while at < len(ends) and k > ends[at][0]:
                left += ends[at][1] * seen
                at += 1
            seen = True
            if left > most:
                n, left = n + 1, 0
            out[k] = n
        return out

    for most in (0, 5, 10, 100):
        got = compact.split_by_overlap(rows, spark.createDataFrame(ends, "largest string, size long"), most).collect()
        assert {r.k: r.output for r in got} == by_hand(most), most


ENTRIES = [(k.encode(), v.encode()) for k, v in [("abc", "def"), ("abd", "dee"), ("bcd", "asa"), ("bsr", "a00"), ("xyz", "xxx"), ("xzz", "yyy"), ("zzz", "111")]]


def test_table_offsets_and_seeks():
    data = tables.pack(ENTRIES, tables.Options(block_bytes=32, restart=2))
    t = tables.Table(data)
    assert [t.offset_of(k) for k, _ in ENTRIES] == [0, 0, 0, 44, 44, 44, 89] and t.offset_of(b"{aa") == 137
    assert list(t.entries()) == ENTRIES and list(t.backwards()) == ENTRIES[::-1]
    assert t.seek(b"bcd") == ENTRIES[2] and t.seek(b"abc") == ENTRIES[0] and t.seek(b"{{{") is None and t.seek(b"bbb") == ENTRIES[2]
    assert all(t.get(k) == (k, v) for k, v in ENTRIES) and t.get(b"somerandomkey") is None
    assert len(t.filters.offsets) == 2 and all(t.filters.may_contain(t.offset_of(k), k) for k, _ in ENTRIES)
    broken = bytearray(data)
    broken[10] += 1
    t = tables.Table(bytes(broken))  # the damage shows where the block is read
    assert len(list(t.entries(b"bsr"))) == 4
    with pytest.raises(Corruption):
        list(t.entries())
    for bad in (data[:-1], data[:20], b""):
        with pytest.raises(Corruption):
            tables.Table(bad)


@pytest.mark.parametrize("codec", [0, 1, 2, 4])
def test_internal_tables(codec):
    keys = [(B.internal_key(k, seq, 1), v) for k, v in ENTRIES for seq in (9, 4, 2)]
    o = tables.Options.internal(codec=codec, block_bytes=32, restart=1)
    t = tables.Table(tables.pack(keys, o), o)
    assert list(t.entries()) == keys
    for k, v in ENTRIES:
        assert t.get(B.internal_key(k, 5, 1)) == (B.internal_key(k, 4, 1), v)
        assert t.get(B.internal_key(k, (1 << 56) - 1, 1)) == (B.internal_key(k, 9, 1), v)
    assert list(tables.Table(tables.pack([], o), o).entries()) == []


def test_filter_blocks():
    keys = [b"abcd", b"efgh", b"ijkl", b"mnopqrstuvwxyz"]
    made = tables.filter_block([(0, keys), (5000, keys)], tables.FilterPolicy(32))
    bits = [234, 195, 25, 155, 61, 141, 173, 140, 221, 28, 222, 92, 220, 112, 234, 227, 22]
    assert list(made) == [*bits, *bits, 0, 0, 0, 0, 17, 0, 0, 0, 17, 0, 0, 0, 34, 0, 0, 0, 11]
    f = tables.Filters(made, tables.FilterPolicy(32))
    assert f.offsets[5121 >> 11] == 17
    for at in (0, 1024, 5000, 6025):
        assert all(f.may_contain(at, k) for k in keys) and not any(f.may_contain(at, k) for k in (b"xsb", b"9sad", b"assssaaaass"))
    assert f.may_contain(99_999, b"any") and tables.Filters(tables.filter_block([(0, keys)], tables.FilterPolicy(0)), tables.FilterPolicy(0)).may_contain(0, b"any")


def test_handles_and_edits():
    assert tables.read_handle(tables.handle(890, 777)) == (890, 777, 4)
    with pytest.raises(Corruption):
        tables.read_handle(b"\x80")
    e = edits.Edit("bytewise", log_number=123, next_file_number=456, pointers=[(0, bytes([0, 1, 2])), (1, bytes([3, 4, 5]))], deleted={(1, 132)}, added=[(0, 901, 234, bytes([5, 6, 7]), bytes([8, 9, 0]))])
    assert edits.Edit.decode(e.encode()) == e and edits.Edit.decode(b"") == edits.Edit()
    for n in range(len(e.encode())):
        try:
            edits.Edit.decode(e.encode()[:n])
        except IOFailure:
            pass
    for bad, error in ((b"\x08\x01", Corruption), (b"\x01\x01\xff", Corruption), (b"\x02", IOFailure), (b"\x05\x01\x09ab", IOFailure)):
        with pytest.raises(error):
            edits.Edit.decode(bad)
