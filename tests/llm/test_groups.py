"""Spelling variants, slot maps and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import runs, sharding, variants

DOCS = "doc_id bigint, text string, word string, n int, block string, shard string, slot int, size int, name string"


def make_docs(spark, rows):
    """Rows of ``doc_id, text`` with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, None, "s", 5, 7, "n") for i, t in rows], DOCS)


def typed(rng, n_docs, words):
    """Texts whose words are now and then misspelt."""
    out = []
    for k in range(n_docs):
        text = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(words)
            if rng.random() < 0.1:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("aeéz") + w[p + 1 :], w[:p] + rng.choice("oñ") + w[p:]])
            text.append(w.capitalize() if rng.random() < 0.2 else w)
        out.append((k, " ".join(text)))
    return out


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                counts[word] += len(word) >= 7
            run = ""
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
        out[w] = (form[w], n, len(others), counts[form[w]] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, out[w][0], root, *out[w][1:])
    return sorted(out.values())


@pytest.mark.parametrize("tile", [3, 1024])
def test_variants_equal_plain_version(spark, tile):
    """A tile of three splits every larger block, as a hot one would be."""
    rng = random.Random(4)
    words = ["interesting", "interessante", "international", "interests", "thoughtful", "throughout", "aaaaaaa", "aaaaaaaa", "aaaaaab", "größere", "économie", "short"]
    rows = typed(rng, 150, words) + [(7, "Interesting interesting"), (None, "interesting interestin"), (900, None), (901, ""), (902, "12 ... \n")]
    rows += [(950, "zeitgeistig zeitgeistik zeitgeisti " * 40)] * 3
    got = variants.spelling_variants(make_docs(spark, rows), tile=tile).collect()
    assert sorted(map(tuple, got)) == plain_variants(rows)
    assert any(r["root"] != r["form"] for r in got if r["form"]) or any(r["form"] for r in got)


def test_chains_of_forms_are_followed(spark):
    counts = {"abcdefgh": 20_000, "abcdefgx": 1_500, "abcdefyx": 140, "abcdezyx": 13, "unrelated": 5}
    formed = spark.createDataFrame(
        [("abcdefgh", 20_000, None), ("abcdefgx", 1_500, "abcdefgh"), ("abcdefyx", 140, "abcdefgx"), ("abcdezyx", 13, "abcdefyx"), ("unrelated", 5, None)], "word string, n bigint, form string"
    )
    got = {r["word"]: r["root"] for r in variants.with_roots(formed, max(counts.values())).collect()}
    assert got == {w: "unrelated" if w == "unrelated" else "abcdefgh" for w in counts}


def test_no_words(spark):
    assert variants.spelling_variants(make_docs(spark, [])).count() == 0
    assert variants.spelling_variants(make_docs(spark, [(1, None), (2, "a bc")])).count() == 0


def shard_rows():
    rng = random.Random(1)
    rows = [(k, "wörd " * rng.randint(0, 40)) for k in range(400)] + [(1000 + k, "same text") for k in range(60)]
    return rows + [(5000, "x" * 3000), (None, "no id"), (None, None), (8, None), (9, "")] + [(77, "one row many times")] * 300


def test_shards_are_near_equal_whole_and_gapless(spark):
    rows = shard_rows()
    docs = make_docs(spark, rows)
    got = sharding.shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 100
    for shard in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    copies = Counter(r["shard"] for r in got if r["doc_id"] == 77)
    assert len(copies) == 8 and max(copies.values()) < 80
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    # unfolding copies in pieces changes nothing
    found = sharding.records(docs)
    assert Counter(map(tuple, sharding.slotted(found, held=7).collect())) == Counter(map(tuple, sharding.slotted(found).collect()))


def test_a_new_shard_takes_rows_only_into_itself(spark, tmp_path):
    placed = sharding.slotted(sharding.records(make_docs(spark, shard_rows())))
    first = sharding.first_map(sharding.slot_sizes(placed))
    path = f"{tmp_path}/maps"
    sharding.store_map(first, path)
    sharding.store_map(sharding.grown_map(sharding.load_map(spark, path)), path)
    old = {r["virtual_slot"]: r for r in sharding.load_map(spark, path, 1).collect()}
    new = {r["virtual_slot"]: r for r in sharding.load_map(spark, path).collect()}
    assert len(old) == len(new) == sharding.SLOTS and {r["version"] for r in new.values()} == {2}
    assert all(new[k]["shard"] in (old[k]["shard"], 8) for k in old)
    loads = Counter()
    for r in new.values():
        loads[r["shard"]] += r["bytes"]
    total = sum(loads.values())
    assert len(loads) == 9 and all(0.7 * total / 9 <= loads[k] <= 1.3 * total / 9 for k in range(9))
    with pytest.raises(FileNotFoundError):
        sharding.load_map(spark, f"{tmp_path}/none")


def test_shard_files_hold_the_rows(spark, tmp_path):
    rows = shard_rows()
    docs = make_docs(spark, rows)
    sharding.write_shards(docs, sharding.shard_documents(docs), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r["doc_id"], r["text"], r["slot_"]) for r in back.select("doc.doc_id", "doc.text", F.col("doc.slot").alias("slot_")).collect()) == Counter((i, t, 5) for i, t in rows)


def test_no_documents_make_no_rows(spark):
    assert sharding.shard_documents(make_docs(spark, [])).count() == 0
    assert runs.report(runs.find_runs(make_docs(spark, []))).count() == 0


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(s == i and n == length and q % p == 0 for s, n, p in found):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_lyndon(letters):
    out = []
    for i in range(len(letters)):
        j = i + 1
        while j < len(letters) and letters[j:] > letters[i:]:
            j += 1
        out.append(j - i)
    return out


def test_lyndon_arrays_and_runs_equal_plain_versions():
    rng = random.Random(2)
    for _ in range(600):
        letters = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            unit = letters[: rng.randint(1, 6)]
            letters = letters[:5] + unit * rng.randint(2, 8) + letters[5:9]
        names = {c: k for k, c in enumerate(sorted(set(letters)))}
        letters = [names[c] for c in letters]
        for order in (letters, [len(names) - 1 - c for c in letters]):
            assert runs.lyndon_array(order, len(names)) == plain_lyndon(order)
        words = [b"%d" % c for c in letters]
        assert runs.text_runs(words) == plain_runs(words)
    with pytest.raises(ValueError):
        runs.text_runs([b"a"] * 9, repeats=2)


def plain_report(doc_id, text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, lines, sha(" ".join(w for k, w in enumerate(words) if k not in dropped)), len(words))


def test_run_report_equals_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = [rng.choice("the a of und größe  x  ".split(" ")) or "e" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at, unit = rng.randrange(len(words) + 1), [rng.choice("pqr") for _ in range(rng.randint(1, 5))]
            words[at:at] = unit * rng.randint(3, 9)
        rows.append((k, rng.choice([" ", "\n", " \x0b\t"]).join(words)))
    rows += [(None, "a b " * 9), (1, None), (2, ""), (3, " \n "), (4, "a " * 5), (5, "a " * 6), (6, "x\u0085" * 9), *[(10, "again and " * 8)] * 3]
    rows += [(50, "long " * 30_000), (51, " ".join(f"w{i % 5000}" for i in range(30_000)))]
    small, long = rows[:-2], rows[-2:]
    got = runs.report(runs.find_runs(make_docs(spark, rows), rewrite=runs.planted)).collect()
    found = Counter(map(tuple, got))
    for row in small:
        assert found[plain_report(*row)] > 0, row
    assert sum(found.values()) == len(rows)
    want = {50: (0, 30_000, 1), 51: (0, 30_000, 5000)}
    for doc_id, _ in long:
        if zlib.crc32(str(doc_id).encode()) % 10:
            assert want[doc_id] in {(r["start"], r["length"], r["period"]) for r in got if r["doc_id"] == doc_id}
