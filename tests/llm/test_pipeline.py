import collections
import random

import corpus_pipeline
from terraloom.llm import bpe_dp, pivotal_mix, secret_forest
from terraloom.llm.vocabularies import BYTE_LEVEL_FILE, published
from test_quality_and_fingerprints import base_rules, groups, simhash


def pipeline_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(150):
        text = " ".join(word() for _ in range(rng.randint(60, 120)))
        if k % 10 == 0:
            text += f' token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}" end'
        if k % 10 == 5:
            text += f" number {''.join(rng.choice('0123456789') for _ in range(16))} end"
        rows.append((k, text, f"s{k % 4}"))
    rows += [(200 + k, rows[k][1], "s1") for k in range(20)]  # copies
    rows += [(300 + k, "spam " * 40, "s2") for k in range(5)] + [(400, None, "s0"), (401, "too short", None)]
    return rows


def test_pipeline_matches_stage_by_stage_version(spark, docs, folder):
    rows = pipeline_rows()
    docs(rows).drop("_row", "row", "_removed").write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    stay = [r for r in rows if (s := base_rules(r[1]))[0] >= 10 and 100 * s[4] <= 20 * s[0]]
    root = groups([simhash(t) for _, t, _ in stay])
    first = {r: min(stay[i][0] for i in range(len(stay)) if root[i] == r) for r in set(root)}
    stay = [r for i, r in enumerate(stay) if r[0] == first[root[i]]]
    masked = []
    for k, text, source in stay:
        at = text.find('token = "')
        masked.append((k, text if at < 0 else f'{text[: at + 9]}{secret_forest.MASK}{text[at + 49 :]}', source))
    assert sum(a != b for a, b in zip(stay, masked, strict=True)) >= 15
    copies = {r["doc_id"]: r["copies"] for r in pivotal_mix.mix(docs(masked)).collect()}
    assert collections.Counter(r["doc_id"] for r in got) == {k: n for k, n in copies.items() if n}
    encoder = bpe_dp.encoder(open(published(BYTE_LEVEL_FILE), "rb").read())
    texts = {k: t for k, t, _ in masked}
    assert all(r["token_ids"] == encoder.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) for r in got)


def test_stages_return_the_columns_of_documents(spark, docs):
    frame = docs(pipeline_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, "").columns == frame.columns


def test_empty_corpus(spark, docs, folder):
    docs([]).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
