import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from refweave.llm import bpe

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, spans string"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def rows():
    rng = random.Random(6)
    words = ["".join(rng.choices("abdeilnorst", k=rng.randrange(2, 8))) for _ in range(600)]
    out, labels = [], []
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randrange(60, 200))) + ".\n"
        good = i % 6 != 0
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### ")])
        out.append([i, text, "en", f"s{i % 4}", len(text), 1, "x"])
        labels.append((i, int(good), 0))
    out[7][1] = "Write to someone@mail.example.com or +1 (743) 555-3824. " + out[7][1]
    out += [[300 + k, out[11][1], "en", "s3", 1, 1, "x"] for k in range(3)]  # exact copies
    edited = out[13][1].split(" ")
    edited[20] = "changed"
    out += [[310, " ".join(edited), "en", "s2", None, 1, None]]
    out += [[320, None, None, None, None, None, None], [None, "", "de", None, 0, 1, "x"], [13, out[13][1], "en", "s1", 3, 1, "x"]]
    return out, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, labels = rows()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    table, found = cp.table(spark, folder, "documents"), []
    columns = table.columns
    for name, stage in cp.STAGES:
        table = cp.written(stage(spark, table, folder), name)
        found.append((name, table.columns, table.collect()))
    return docs, columns, found


def test_stages_return_documents(stages):
    _, columns, found = stages
    assert [n for n, *_ in found] == ["quality_classifier", "simhash_near_dedup", "pii", "mixing", "byte_bpe"]
    assert all(c == columns for _, c, _ in found[:-1])


def test_junk_goes_and_clean_stays(stages):
    docs, _, found = stages
    kept = {r.doc_id for r in found[0][2]}
    assert not any(i in kept for i in range(0, 240, 6))
    assert all(i in kept for i in range(240) if i % 6)


def test_one_of_each_group_stays(stages):
    before, after = stages[2][0][2], stages[2][1][2]
    ids = [r.doc_id for r in after]
    assert len(set(ids)) == len(ids) and {11, 13} <= set(ids) and not {300, 301, 302, 310} & set(ids)
    gone = {r.doc_id for r in before} - set(ids)
    assert gone <= {300, 301, 302, 310, 320, None}


def test_personal_data_is_replaced(stages):
    before, after = ({r.doc_id: r for r in stages[2][n][2]} for n in (1, 2))
    assert before.keys() == after.keys()
    assert after[7].text.startswith("Write to [EMAIL] or [PHONE]. ") and after[7].n_chars == len(after[7].text)
    same = [i for i in before if before[i].text == after[i].text]
    assert len(same) >= len(before) - 1 and all(before[i].n_chars == after[i].n_chars for i in same)


def test_mix_takes_half_again_as_many_words(stages):
    before, after = (stages[2][n][2] for n in (2, 3))
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(after) / words(before) - 1.5) < 0.1
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert max(sum(a.doc_id == r.doc_id for a in after) for r in after) <= 2


def test_ids_are_the_library_s(stages):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ids, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[2][3][2]}
    encoded = stages[2][4][2]
    assert sorted(str(r.doc_id) for r in encoded) == sorted(str(r.doc_id) for r in stages[2][3][2])
    for r in encoded:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "")
