"""Operators on single texts against public libraries, round trips, brute force and labelled cases."""

import hashlib
import itertools
import random
import textwrap
import time
import zlib
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import attention, blocks, chat, langid, licences, lm, maintext, pieces, quality, tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
POOL = list("abcdefgh ''st  \n\t0129.,!é漢😀ñßİΣ▁<|>")
ODD = ["", "  ", "a" * 40, "<|endoftext|>x<|startoftext|>", "it's We'LL 'start", "ΑΣ Σας", "x\n\n y\r\n\tz", "a   b     c", "▁a ▁▁ b", "\x00\x1c", "ab" * 3000]


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choices(POOL, k=rng.randint(1, 50))) for _ in range(n)]


def frame(spark, texts, extra="row string, ids int"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def test_token_counts_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*odd_texts(), None]
    library = tokenizers.Tokenizer.from_file(path)
    expected = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    got = tokencount.token_counts(frame(spark, texts), path, limit=30).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 30) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in got)
    assert tokencount.token_counts(frame(spark, [None]).limit(0), path).count() == 0


def test_every_character_counts_as_in_the_library():
    """All characters below U+20000 and the ranges of newer letters, next to letters, signs and digits."""
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), tokencount.TokenCounter(path)
    points = [*range(0x20000), *range(0x2B730, 0x2B830), *range(0x2CE90, 0x2CEC0), *range(0x32300, 0x33500, 7), *range(0x3D000, 0x3FD00, 97)]
    texts = [f"a{c}9{c}={c}{c}b" for c in map(chr, points) if not "\ud800" <= c <= "\udfff"]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, own.count(texts), expected, strict=True) if a != b] == []


def test_forgetting_changes_no_count(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts(50)
    expected = tokencount.TokenCounter(path).count(texts)
    monkeypatch.setattr(tokencount, "REMEMBERED", 7)
    monkeypatch.setattr(tokencount, "SLICE_CHARS", 40)
    assert tokencount.TokenCounter(path).count(texts) == expected


def test_piece_ids_equal_the_library_and_decode_again(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*odd_texts(), None]
    encoded = pieces.encode(frame(spark, texts), path)
    assert encoded.columns == ["doc_id", "row", "ids"]
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    decoded = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, path).collect()}
    assert decoded == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}


def test_long_and_short_units_take_the_same_path(monkeypatch):
    machine = pieces.PieceTransducer(public_tokenizers.path("piece_bpe_32k.model"))
    texts = odd_texts(200, 9)
    expected = [machine.encode(t).tolist() for t in texts]
    monkeypatch.setattr(pieces, "SHORT_UNIT", 0)
    machine.known.clear()
    assert [machine.encode(t).tolist() for t in texts] == expected


def repeats(text):
    w = [x for x in "".join(" " if c in quality.SPACES else c for c in text).split(" ") if x]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    return len({k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)})


def test_quality_measures_and_order(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(60)] + ["a b c a b c\na\na\n\n", None, "", "x\x0b\x0c y"]
    got = {r["doc_id"]: r for r in quality.measure(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_repeat_words"] == repeats(t or ""), t
    assert got[60]["n_dup_lines"] == 1 and got[61]["base_failed"] and not got[61]["kept"] and got[63]["n_words"] == 2
    good = " ".join(f"word{k}" for k in range(60))
    docs = frame(spark, [good, good + " ###" * 30, good.upper(), "few words", None], "words string, text_ int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [0]
    names = quality.cascade_order(quality.prepared(docs))
    assert sorted(names) == sorted(r.name for r in quality.rules(docs["text"], docs["text"]))


def test_chat_reads_back_what_was_said(spark):
    control = "</s>[INST] ok [/INST]"
    turns = [
        (1, 0, "system", "a\\lb<s>["), (1, 1, "user", control), (1, 2, "assistant", control), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "\\e\\\\"),
        (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "r]<o", "é\n"), (4, 0, None, "x"), (None, 0, "assistant", "n"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand(df)
    assert all(control not in r["text"] for r in examples.collect())
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").count().withColumnRenamed("count", "n").collect()} == {1: 3, 2: 1, 3: 3, 4: 1, None: 1}
    assert chat.digests(chat.expand(df.limit(0))).count() == 0


def test_languages_on_held_out_rows(spark):
    rng = random.Random(6)
    words = {"aa": ["kala", "maki", "talo", "sana"], "bb": ["strengt", "schrift", "wuchs", "fjord"], "cc": ["öljö", "ääni", "yöö", "hyvä"]}
    rows = [(k, " ".join(rng.choices(words[x], k=rng.randint(3, 30))), x, "s", 1) for k in range(400) for x in [rng.choice(sorted(words))]]
    rows += [(900, None, "aa", "s", 1), (901, "123 !?", "bb", "s", 1), (902, "talo", None, "s", 1), (None, "kala maki", "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, accepted int")
    got = langid.identify(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[900]["lang_pred"] == by_id[901]["lang_pred"] == "und" and not by_id[901]["accepted"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_licences(spark):
    texts = [
        "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */",
        "x\nReleased under the MIT License.\ny\nAll rights reserved.", "All rights reserved.", "# SPDX-License-Identifier: ISC\n", None, "no such words", "The licence of things is odd.",
        "Licensed under the Apache Licence, Version 2.0.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
    ]
    got = {r["doc_id"]: r["licences"] for r in licences.report(licences.scan(frame(spark, texts, "found string, licence int"))).collect()}
    assert got == {0: "GPL-3-or-later", 1: "MIT", 2: "All-Rights-Reserved", 3: "ISC", 4: "", 5: "", 6: "", 7: "Apache-2.0,CC-BY-NC-4.0"}


APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]


@pytest.mark.parametrize("width", [28, 40, 60, 72, 100])
def test_published_notices_at_several_widths(width):
    rules = licences.SentenceRules()
    for sign in ("", "// ", " * ", "# "):
        wrapped = [[sign + line for line in textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False)] for x in APACHE]
        text = f"\n{sign}\n".join("\n".join(x) for x in wrapped) + "\n\nimport os\n"
        known, found, rest = rules.scan(text)
        assert [f.licence for f in found] == ["Apache-2.0"] and rest == 0
        assert [name for name, *_ in known] == ["apache", "apache-exception", "apache-copy", "apache-as-is", "apache-see"]
        mit = "\n".join(sign + line for line in textwrap.wrap(licences.SENTENCES["mit-grant"] + ":", width))
        assert [name for name, *_ in rules.scan(mit)[0]] == ["mit-grant"]
    cc = "This work is licensed under a Creative Commons\nAttribution 4.0 International License.\nOther words."
    assert [f.licence for f in rules.scan(cc)[1]] == ["CC-ATTRIBUTION-4.0-INTERNATIONAL-LICENSE"]
    assert [f.licence for f in rules.scan("SPDX-License-Identifier: ISC\nimport licence\n")[1]] == ["ISC"]


def test_windows_score_every_position_once_and_look_back_only():
    sizes = np.array([1, 32, 33, 100, 57])
    first = np.cumsum(sizes) - sizes
    w = attention.windows(sizes, first)
    assert (np.bincount(w.at[w.scored], minlength=sizes.sum()) == 1).all()
    model = attention.AttentionModel(np.ones(attention.CLASSES) / attention.CLASSES)
    rng = np.random.default_rng(0)
    head, tail, wanted = rng.integers(0, 4096, sizes.sum()), rng.integers(0, 1024, sizes.sum()), rng.integers(0, 64, sizes.sum())
    before = model.class_scores(head, tail, wanted, w)
    changed = head.copy()
    changed[first[3] + 60 :] = 5
    after = model.class_scores(changed, tail, wanted, w)
    assert np.allclose(before[: first[3] + 60], after[: first[3] + 60]) and not np.allclose(before[first[3] + 60 :], after[first[3] + 60 :])


def test_gradients_of_the_model():
    """A step along the gradient lowers the loss."""
    model = attention.AttentionModel(np.ones(attention.CLASSES) / attention.CLASSES)
    head = np.tile(np.arange(40) % 7, 30)
    sizes = np.full(30, 40)
    w = attention.windows(sizes, np.arange(30) * 40)
    wanted = (head + 1) % 7
    used = {k: np.zeros(len(v)) for k, v in model.params.items()}
    squares = {k: np.zeros_like(v) for k, v in model.params.items()}
    before = model.class_scores(head, head, wanted, w).mean()
    for _ in range(20):
        model.fit(head, head, wanted, w, used, squares)
    assert model.class_scores(head, head, wanted, w).mean() > max(-0.2, before)


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(["a", "B", "b", "cc", "dd", "é", "zz9"], k=rng.randint(0, 70))) for _ in range(60)] + [None, "", "x " * 3000, "unseen words"]
    got = {r["doc_id"]: r for r in lm.score(frame(spark, texts, "words string, idx int")).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts: dict = {}
    for i, ws in tokens.items():
        for x in [] if held[i] else ws:
            counts[x] = counts.get(x, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(log10((counts.get(x, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for x in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(x in counts for x in ws), total)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base)) and r["score"] < 0
    assert lm.score(frame(spark, [None]).limit(0)).count() == 0


def test_training_steps_over_every_window_once(spark, monkeypatch):
    texts = [f"q{i}z common words " + "a b c " * (i % 40) for i in range(80)]
    named = spark.createDataFrame([(i, t, i % 10 == 0) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    cells = named.coalesce(1).mapInArrow(lm._to_blocks, lm.BLOCKS).filter("words is not null")
    batches = cells.select(*lm.BLOCK_COLUMNS).toArrow().to_batches()
    stepped = []
    monkeypatch.setattr(attention.AttentionModel, "fit", lambda self, head, tail, wanted, w, *_: stepped.extend(map(tuple, w.at.tolist())))
    classes = np.zeros(lm.HEADS, np.int64)
    for turn in range(lm.ROUNDS):
        list(lm._trainer(attention.AttentionModel(np.ones(attention.CLASSES) / attention.CLASSES), classes, turn)(iter(batches)))
    every, heads = [], set()
    for _, b in lm._blocks_of(iter(batches)):
        train = np.flatnonzero(~b.held)
        every += map(tuple, attention.windows(b.sizes[train], b.first[train]).at.tolist())
        heads |= set(b.heads[b.words][np.repeat(~b.held, b.n)].tolist())
    assert len(every) > 72 and sorted(stepped) == sorted(every)
    together = list(lm._together(np.array(sorted(heads)))(iter(batches)))
    assert {h for x in together for h in x.column(0).to_pylist()} == heads


def test_main_text(spark):
    pages = [
        "<body><header><h1>My Site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>Real &amp; true</h1><p>Text one\n is <b>here</b>.<br>On"
        "<aside class='related'><p>See also this.</p></aside><p>Text two.<!-- <p>no</p> --><script>var t='</p>';</script></p><form><label>Mail</label><button>Go</button></form>"
        "</article><section id=comments><h2>Comments</h2><p>Great post! I really love it.</p></section></main><footer><p>&copy; 2020 All.</p></footer>",
        None, "", "<p>plain only", "<script>x", "<nav><ul><li><a>m</a></ul></nav>",
    ]
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in maintext.extract(df).collect()}
    assert got[0]["text"] == "Real & true\nText one is here. On\nText two."
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5)] == ["", "", "plain only", "", ""]
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == f"u{r['page_id']}" for r in got.values())


def test_broken_and_deep_pages():
    """Markup never becomes text, and a megabyte of nested or unclosed tags takes time in proportion."""
    texts = lambda html: [b.text for b in blocks.blocks(html)]
    assert texts("<p>a<div class='x") == ["a"]
    assert texts('<p>1 < 2 <a href="x>t</a> &amp; u') == ["1 < 2 t & u"]
    assert texts("<p title=\"a>b\" don't>c</p><!-- d --><!e><?f></ g>h") == ["c", "h"]
    assert texts("<p>a<b>b<p>c</b>d<ul><li>e<li>f</ul>") == ["ab", "cd", "e", "f"]
    assert texts("a<SCRIPT>b</p></script >c<style>d") == ["ac"]
    n = 100_000
    deep = ["<div>" * 2 * n, "<i><div>" + "<b>" * n + "</i>x<div>" * n, "<a b='" * n, "<p " * 3 * n, "".join(f"<x{i}>" for i in range(n)), "<!--" * n,
            "<script " * n, "<" * 10 * n, "<a =" + "=" * 10 * n, "<p>x" * n, "<li><ul>" * n]
    for page in deep:
        start = time.process_time()
        blocks.blocks(page)
        assert time.process_time() - start < 5, page[:20]


def test_paths_and_sums_equal_enumerated_paths():
    """Viterbi paths of random chains against the best of all label sequences."""
    rng = np.random.default_rng(5)
    names = {f: k for k, f in enumerate("abcde")}
    model = maintext.ChainModel(names, rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    pages = [[list(rng.choice([*"abcde", "unknown"], size=3, replace=False)) for _ in range(n)] for n in (1, 2, 3, 6, 9)]
    for page, found in zip(pages, model.decode(pages), strict=True):
        def value(path):
            total = model.first[path[0]] + sum(model.pair[a, b] for a, b in itertools.pairwise(path))
            return total + sum(model.state[names[f], y] for block, y in zip(page, path, strict=True) for f in block if f in names)

        assert tuple(int(y) for y in found) == max(itertools.product((0, 1), repeat=len(page)), key=value)


def test_labels_of_held_out_pages():
    model = maintext.train(maintext.labelled_pages(300))
    pages = maintext.labelled_pages(120, 77)
    wrong = sum(int((d != np.array(y)).sum()) for d, (_, y) in zip(model.decode([p for p, _ in pages]), pages, strict=True))
    assert wrong < 0.01 * sum(len(y) for _, y in pages)


def test_ids_of_many_texts_are_read_at_once():
    """One gathering for all ids: only a text's own first piece loses its space, empty texts and broken bytes keep their places."""
    import pyarrow as pa

    machine = pieces.PieceTransducer(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", " a  b", "", "x y\n z", "é\U0001f600"]
    ids = [machine.encode(t) for t in texts] + [np.array([machine.bytes[0xFF], machine.bytes[0xC3]], np.int32)]
    silent = machine.surfaces().index(b"")
    ids += [np.array([silent], np.int32), np.append(np.int32(silent), machine.encode("a b"))]
    cuts, flat = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
    read = pieces._read(pieces._surfaces(machine), flat, cuts)
    assert read.type == pa.string() and read.to_pylist() == [machine.decode(i.tolist()) for i in ids]
    assert read.to_pylist()[:5] == texts
