import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import packing, pii, quality
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_minhash import brute as brute_near

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    benchmark = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = list(zip(benchmark["item_id"], benchmark["text"]))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in out.collect()}
        rows = [(d, r.text) for d, r in before.items()]
        if name == "quality":
            net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            score = {d: net.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for d, t in rows}
            sure = {d for d, s in score.items() if abs(s - quality.THRESHOLD) > 1e-3}
            assert {d for d in after if d in sure} == {d for d in sure if score[d] >= quality.THRESHOLD}
            assert 0 < len(after) < len(before)
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, _, kept in brute_near(rows, 80) if kept}  # no contract names another similarity for the stage
        elif name == "decontamination":
            assert set(after) == set(before) - {d for d, _ in brute_leaks(rows, items)}
        elif name == "personal_data":
            assert set(after) == set(before)
            for d, r in after.items():
                assert r.n_chars == len(r.text) and not pii.base_spans(r.text) or "<" in r.text
                assert r.text == before[d].text or "<" in r.text
        else:
            tok = Tokenizer.from_file(packing.vocabulary())
            want, got, places = [], [], {}
            for d, r in before.items():
                ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, packing.END]
                cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
                want += [(d, n, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for n, (a, z) in enumerate(zip(cuts, cuts[1:]))]
            for r in out.collect():
                got.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
                places.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert sorted(got) == sorted(want)
            for x in places.values():
                x.sort()
                assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024
            bound = packing.lower_bound(np.bincount([x[3] for x in want], minlength=1025))
            assert bound <= len(places) <= bound + 1
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
