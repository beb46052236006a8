"""The ten queries against brute force over the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headerloom.llm import langid, mixing, store, toxicity
from headerloom.llm.queries import ORACLE_SQL, QUERIES
from headerloom.llm.tokens import tokenizer_path


def table(folder, name):
    return pd.read_parquet(f"{folder}/{name}.parquet")


def same(got: pd.DataFrame, expected: pd.DataFrame, key):
    columns = list(expected.columns)
    pd.testing.assert_frame_equal(got[columns].sort_values(key).reset_index(drop=True), expected.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_op1_is_earliest_deadline_first(spark, small):
    docs = table(small, "documents")
    got = QUERIES["op1_mixing"](spark, small).toPandas()
    assert sorted(got["mix_position"]) == list(range(len(docs)))
    counts = docs["source"].value_counts().to_dict()
    parts = mixing.weight_parts({s: n**mixing.TEMPERATURE for s, n in counts.items()})
    left = {s: -(-n // mixing.BLOCK_ROWS) for s, n in counts.items()}
    expected, phase, t, done, base = {}, 0, 0, Counter(), dict.fromkeys(left, 0)
    total = sum(parts[s] for s in left)
    slot = 0
    while left:
        ready = [(-(-(done[s] + 1) * total // parts[s]), s) for s in left if done[s] * total // parts[s] <= t]
        _, s = min(ready)
        expected[s, base[s] + done[s]] = (phase, slot)
        done[s] += 1
        left[s] -= 1
        t, slot = t + 1, slot + 1
        for x in left:
            assert abs(done[x] - t * parts[x] / total) < 1
        if not left[s]:
            del left[s]
            for x in base:
                base[x] += done[x]
            done, t, phase, total = Counter(), 0, phase + 1, sum(parts[x] for x in left)
    found = {(r.source, r.mix_block): (r.mix_phase, r.mix_slot) for r in got.itertuples()}
    assert found == expected
    order = got.sort_values("mix_position")
    assert order["mix_slot"].is_monotonic_increasing
    assert got.merge(docs[["doc_id", "source"]], on=["doc_id", "source"]).shape[0] == len(docs)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    expected = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, small).toPandas()
    assert set(got.columns) == set(expected.columns)
    same(got, expected, {"op11_lexical_search": ["item_id", "rank"], "op12_url_filter": "page_id"}.get(name, "doc_id"))


def test_op3_fuses_the_evidence(spark, tiny):
    names, logs = langid.train(spark.read.parquet(f"{tiny}/documents.parquet"))
    got = QUERIES["op3_language"](spark, tiny).toPandas().set_index("page_id")
    pages = table(tiny, "pages")
    rows = []
    for p in pages.itertuples():
        host = re.match(r"\w+://([^/?#:]*)", p.url)[1]
        h = langid.trigrams(langid.visible_text(p.html))
        text = logs[:, h].mean(axis=1) * (len(h) * langid.TEXT_WEIGHT / (len(h) + langid.TEXT_WEIGHT))
        own = np.exp(text - text.max())
        rows.append((p.page_id, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], re.search(r'lang="(\w+)', p.html)[1], text - text.max(), own / own.sum()))
    n = len(names)
    sums = [defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    pages_of = [Counter() for _ in range(4)]
    for r in rows:
        for k in range(4):
            sums[k][r[k + 1]] += r[6]
            pages_of[k][r[k + 1]] += 1
    everything = sum(r[6] for r in rows)
    overall = (everything + 1) / (len(rows) + n)

    def given(k, value):
        return np.log((sums[k][value] + langid.VALUE_SMOOTHING) / (sum(sums[k].values()) + langid.VALUE_SMOOTHING * (len(pages_of[k]) + 1)))

    for page_id, host, domain, suffix, declared, text, own in rows:
        d = (sums[1][domain] - own + langid.DOMAIN_SMOOTHING * overall) / (pages_of[1][domain] - 1 + langid.DOMAIN_SMOOTHING)
        h = (sums[0][host] - own + langid.HOST_SMOOTHING * d) / (pages_of[0][host] - 1 + langid.HOST_SMOOTHING)
        x = text + given(2, suffix) + given(3, declared) + np.log(np.maximum(h, 1e-12))
        assert got.loc[page_id, "lang"] == names[int(x.argmax())]
        assert got.loc[page_id, "confidence"] == pytest.approx(1 / np.exp(x - x.max()).sum(), abs=1e-5)
    assert len(got) == len(pages)
    assert (got["lang"] == got["declared"]).mean() > 0.95


def test_op4_counts_as_the_library_does(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = table(small, "documents")
    n = [len(e.ids) for e in tok.encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)]
    expected = pd.DataFrame({"doc_id": docs["doc_id"], "n_bytes": docs["text"].fillna("").str.encode("utf-8").str.len(), "n_tokens": n, "over_limit": [x > 1024 for x in n]})
    same(QUERIES["op4_token_counts"](spark, small).toPandas(), expected, "doc_id")


def test_op5_says_every_turn_once(spark, small):
    turns = table(small, "conversations").sort_values(["conv_id", "turn"])
    probe = "</s>[INST] ok [/INST]"
    turns = pd.concat([turns, pd.DataFrame({"conv_id": [-1, -1], "turn": [0, 1], "role": ["user", "assistant"], "text": [probe, probe]})])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = []
    for conv, g in turns.groupby("conv_id"):
        learned = "".join(g.loc[g["role"] == "assistant", "text"])
        rows.append((conv, len(g), sha("".join(f"{r}\n{t}\n" for r, t in zip(g["role"], g["text"], strict=True))), len(learned), sha(learned)))
    got = QUERIES["op5_chat"](spark, small).toPandas()
    same(got, pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]), "conv_id")
    assert (got["formatted_chars"] > got["loss_chars"]).all()


def test_op6_finds_every_window(spark, small):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item in table(small, "benchmark").itertuples():
        w = words(item.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item.item_id)
    sizes = sorted({len(w) for w in windows})
    rows = []
    for d in table(small, "documents").itertuples():
        w, hit, items = words(d.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= found
        rows.append((d.doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = pd.DataFrame(rows, columns=columns)
    assert expected["contaminated"].sum() > 5
    same(QUERIES["op6_decontamination"](spark, small).toPandas(), expected, "doc_id")


def test_op7_links_what_brute_force_links(spark, small):
    from xxhash import xxh64_intdigest

    docs = table(small, "documents")
    prints = []
    for text in docs["text"].fillna(""):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        hashes = [xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    fp = np.array(prints, dtype=np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i:] ^ fp[i]) <= 4) + i:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    ids = docs["doc_id"].to_numpy()
    least = defaultdict(lambda: math.inf)
    for i in range(len(fp)):
        least[find(i)] = min(least[find(i)], ids[i])
    expected = pd.DataFrame({"doc_id": ids, "fingerprint": [f"{p:016x}" for p in prints], "component_id": [least[find(i)] for i in range(len(fp))]})
    same(QUERIES["op7_simhash"](spark, small).toPandas(), expected, "doc_id")


def test_op8_stores_all_bytes(spark, small):
    rows = []
    for d in table(small, "documents").itertuples():
        raw = (d.text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        media = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        rows.append((d.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    got = QUERIES["op8_media"](spark, small).toPandas()
    same(got, pd.DataFrame(rows, columns=columns), "doc_id")
    assert got.groupby("media_sha256")["feature"].nunique().max() == 1


def test_op9_tells_toxic_documents_apart(spark, small):
    got = QUERIES["op9_toxicity"](spark, small).toPandas()
    docs = table(small, "documents")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    labels = table(small, "labels").merge(docs, on="doc_id").merge(got, on="doc_id")
    unseen = labels[labels["held_out"] & (labels["lang"] == "en")]
    toxic, clean = unseen.loc[unseen["toxic"] == 1, "score"], unseen.loc[unseen["toxic"] == 0, "score"]
    assert np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean]) > 0.85
    assert (clean >= 0.7).mean() < 0.05


def test_op9_finds_held_out_toxic_documents_of_each_language(spark, large):
    docs = table(large, "documents")
    got = QUERIES["op9_toxicity"](spark, large).toPandas()
    rows = table(large, "labels").merge(docs, on="doc_id").merge(got, on="doc_id")
    rows = rows[rows["held_out"]]
    for lang, g in rows.groupby("lang"):
        toxic, clean = g[g["toxic"] == 1], g[g["toxic"] == 0]
        assert len(toxic) >= 10
        assert toxic["predicted"].mean() >= 0.9, lang
        assert clean["predicted"].mean() <= 0.01, lang


def test_op9_scores_without_the_automaton(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    words = {t.strip(): w for t, w in model.lexicon.items() if t.endswith(" ")}
    beginnings = {t.strip(): w for t, w in model.lexicon.items() if not t.endswith(" ")}
    for d in table(small, "documents").itertuples():
        found, total, largest = toxicity.fold(d.text or "").split(), 0.0, 0.0
        for i, w in enumerate(found):
            if any(p in model.exceptions for p in (" ".join(found[max(0, i - 1) : i + 1]), " ".join(found[i : i + 2]))):
                continue
            weight = max([words.get(w, 0.0), *(v for b, v in beginnings.items() if w.startswith(b))])
            total, largest = total + weight, max(largest, weight)
        x = np.array([[np.log1p(total), np.log1p(1000 * total / max(20, len(found))), largest]])
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-(x @ np.array(model.curve[1:]) + model.curve[0])[0])), abs=1e-9)


def test_op9_learns_nothing_from_held_out_labels(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x.where(~toxicity.held_out(F.col("doc_id")))) for x in (labels, turned))
    assert a.lexicon == b.lexicon
    assert a.curve == pytest.approx(b.curve)


def test_op10_reads_back_what_the_library_encodes(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = table(small, "documents").sort_values("doc_id")
    ids = [[*e.ids, 2] for e in tok.encode_batch(docs["text"].fillna("").tolist(), add_special_tokens=False)]
    n = [len(x) for x in ids]
    expected = pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "start": np.cumsum([0, *n[:-1]]), "n_tokens": n, "ids_crc32": [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in ids]})
    same(QUERIES["op10_token_store"](spark, small).toPandas(), expected, "doc_id")


def test_op10_stores_a_chunk_once_and_rebuilds(spark, small):
    path = tokenizer_path()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    where = store.write_store(docs, path)
    objects = pd.read_parquet(f"{where}/objects").query("kind == 'chunk'")
    assert objects["key"].is_unique
    recipes = spark.read.parquet(f"{where}/recipes").toPandas()
    refs = sum(len(c) for c in recipes["chunks"])
    assert len(objects) < refs
    rebuilt = store.read_ids(spark, where, path).toPandas().set_index("id")["ids"]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    for d in table(small, "documents").itertuples():
        assert np.frombuffer(rebuilt[d.doc_id], "<u2").tolist() == [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
