"""Each stage of the pipeline, on what the stage before it kept, against a plain version of it."""

from collections import Counter, defaultdict

import corpus_pipeline
from kvlake.llm import lines, mixing, toxicity
from tests.llm.test_exact import DOC, WORD, brute_groups, edge_rows, sentencepiece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    assert df.columns[:5] == COLUMNS
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def brute_lines(rows):
    """Every run of lines of MIN_BLOCK_WORDS words or more goes that one document of smaller id holds as a run, by trying all; lines are compared as words."""
    cut, held = {}, defaultdict(dict)
    for d, t, *_ in rows:
        cut[d] = [(s, s + n, tuple(WORD.findall(t[s : s + n]))) for s, n, _, _ in lines.lines_of(t or "").tolist()]
    every = {d: [(i, j) for i in range(len(c)) for j in range(i, min(i + 6, len(c))) if sum(len(x[2]) for x in c[i : j + 1]) >= lines.MIN_BLOCK_WORDS] for d, c in cut.items()}
    for d, c in cut.items():
        for i, j in every[d]:
            held[tuple(x[2] for x in c[i : j + 1])][d] = True
    out = Counter()
    for (d, t, *rest), n in rows.items():
        c = cut[d]
        gone = {x for i, j in every[d] if min(held[tuple(x[2] for x in c[i : j + 1])]) < d for x in range(i, j + 1)}
        if gone:
            t = "".join(t[s:e] for k, (s, e, _) in enumerate(c) if k not in gone)
        out[(d, t, *rest)] += n
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "mixing", "sentencepiece"]
    stage = dict(corpus_pipeline.STAGES)

    def kept(name, before):
        out = corpus_pipeline.keep(stage[name](spark, before, sf_dir), "stage")
        return out, rows_of(out)

    was = rows_of(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, now = kept("toxicity", docs)
    assert now == Counter({r: n for r, n in was.items() if model.score(r[1]) < 0.5}) and 0 < len(now) < len(was)

    was = now
    docs, now = kept("line dedup", docs)
    assert now == brute_lines(was) and now != was

    was = now
    docs, now = kept("near-dedup", docs)
    groups = brute_groups([(r[0], r[1]) for r in was], 80)
    assert now == Counter({r: n for r, n in was.items() if groups[r[0]][1] == r[0]})

    was = now
    docs, now = kept("mixing", docs)
    assert set(now) <= set(was) and max(now.values()) <= 3
    size = {r: len(WORD.findall(r[1] or "")) for r in was}
    told = mixing.targets([(s, sum(n for r, n in size.items() if r[3] == s)) for s in {r[3] for r in was}])
    for s, _, target in told:
        taken = sum(size[r] * n for r, n in now.items() if r[3] == s)
        assert abs(taken - target) <= max(n for r, n in size.items() if r[3] == s) * 3

    sp = sentencepiece_model()
    last = stage["sentencepiece"](spark, docs, sf_dir)
    assert last.columns == [*COLUMNS, "token_ids"]
    assert Counter((r.doc_id, r.text, tuple(r.token_ids)) for r in last.collect()) == Counter({(r[0], r[1], tuple(sp.encode(r[1] or "", add_eos=True))): n for r, n in now.items()})
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter({r[0]: n for r, n in now.items()})


def test_stages_take_any_rows(spark, sf_dir):
    for rows in ([], edge_rows()):
        docs = spark.createDataFrame(rows, DOC)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.keep(stage(spark, docs, sf_dir), "stage")
            assert docs.columns[:5] == COLUMNS
