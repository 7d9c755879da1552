"""Each operator against a brute-force version in plain Python, on rows with every edge case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


# 1


def test_fertility_base(docs):
    from tachygraph.llm.fertility import judged, quality_filter

    want = []
    for doc_id, text in pairs_of(docs, "doc_id", "text"):
        t = text or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        at = defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        inside = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)))
    got = judged(docs, ["doc_id"])
    assert sorted(pairs_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), key=str) == sorted(want, key=str)
    assert got.filter("kept and base_failed").isEmpty()
    kept = quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def test_fertility_bands(spark, empty):
    from tachygraph.llm.fertility import measured

    rng = random.Random(4)
    noise = " ".join("".join(chr(rng.randint(0x2500, 0x2BFF)) for _ in range(8)) for _ in range(60))
    plain = "The committee will meet again on Thursday to discuss the budget and the plans for the new library building. " * 1
    rows = [(1, plain + "Members may send written comments before then, and all of them will be read.", "en"), (2, noise, "en")]
    got = {r["doc_id"]: r for r in measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and got[2]["fallback_share"] > 0.5
    assert measured(empty, ["doc_id"]).count() == 0


def test_fertility_measures_against_plain_tokenising(spark, docs):
    """Every measure and the wide bands' verdict, text by text, with the tokenisers called directly."""
    import base64
    import math

    import sentencepiece
    import tiktoken

    from tachygraph.llm import fertility

    with open(f"{fertility.VOCABULARY_DIR}/{fertility.BYTE_VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
    encoder = tiktoken.Encoding("plain", pat_str=fertility.BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.VOCABULARY_DIR}/{fertility.PIECE_VOCABULARY}")
    rows = [r for r in docs.select("doc_id", "text", "lang").collect()]
    got = {r["doc_id"]: r for r in fertility.measured(docs, ["doc_id"]).collect()}
    for r in rows:
        text, g = r["text"] or "", got[r["doc_id"]]
        one, two = encoder.encode(text, disallowed_special=()), pieces.encode(text)
        assert (g["n_tokens"], g["n_pieces"]) == (len(one), len(two))
        if not one or not two:
            assert g["chars_per_token"] is None and not g["kept"]
            continue
        chars, chars2 = len(text) / len(one), len(text) / len(two)
        fallback = sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", pieces.id_to_piece(i))) for i in two) / len(two)
        bits = -sum(n / len(one) * math.log2(n / len(one)) for n in Counter(one).values())
        assert [g[c] for c in ("chars_per_token", "chars_per_piece", "fallback_share", "token_entropy")] == pytest.approx([chars, chars2, fallback, bits], abs=1e-9)
        band = fertility.LANGUAGE_BANDS.get(r["lang"]) or fertility.BANDS[g["script"]]
        inside = band.min_chars <= chars <= band.max_chars and band.min_chars <= chars2 <= 1.25 * band.max_chars
        inside = inside and fallback <= band.max_fallback and bits >= band.min_entropy_share * math.log2(min(max(len(one), 2), 256)) - 1e-12
        assert g["kept"] == (inside and not g["base_failed"])
    by_script = {"latin": "Ünïcödé words", "cyrillic": "слово за словом", "cjk": "漢字", "greek": "λόγος", "other": "123 ."}
    made = spark.createDataFrame([(k, t, None) for k, t in enumerate(by_script.values())], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["script"] for r in fertility.measured(made, ["doc_id"]).collect()} == dict(enumerate(by_script))


def test_fertility_learned_bands(spark, empty):
    """The narrow bands against the same rule in plain Python."""
    import math

    from tachygraph.llm import fertility

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fertility.judged(docs, ["doc_id", "lang"]).collect()
    plain = {r["doc_id"]: r["kept"] for r in fertility.measured(docs, ["doc_id"]).collect()}
    by = defaultdict(list)
    for r in got:
        if not r["base_failed"] and r["n_tokens"]:
            by[r["lang"]].append(r)

    def quantile(xs, step, share):
        bins = sorted(math.floor(x / step) for x in xs)
        return (next(b for k, b in enumerate(bins, 1) if k >= share * len(bins)) + 0.5) * step

    sides = defaultdict(list)
    for lang, rows in by.items():
        for chars, n in (("chars_per_token", "n_tokens"), ("chars_per_piece", "n_pieces")):
            centre = quantile([r[chars] for r in rows], 0.01, 0.5)
            off = [(r[chars] - centre) * math.sqrt(r[n]) for r in rows]
            spread = max(0.05, (quantile(off, 0.05, 0.75) - quantile(off, 0.05, 0.25)) / 1.349) * (1 + 100 / len(rows))
            for r, z in zip(rows, off):
                d = r[chars] - centre
                sides[r["doc_id"]].append((d > 0) - (d < 0) if abs(d) > 0.05 * centre and abs(z) > 6 * spread else 0)
    want = {i: plain[i] and not (len(sides[i]) == 2 and sides[i][0] == sides[i][1] != 0) for i in plain}
    assert {r["doc_id"]: r["kept"] for r in got} == want
    assert 0 < sum(plain.values()) - sum(want.values()) < 0.1 * len(plain)
    assert fertility.judged(empty, ["doc_id"]).count() == 0


# 2


def test_quotation(spark):
    from tachygraph.llm.quotation import reply_order

    rows = [(1, 0, "u", "Hello there, world.\nSecond line"), (1, 1, "a", "> hello  there, World.\nI agree"), (1, 2, "u", ">> Hello there, world.\n> I agree\nNo"), (1, 3, "a", "fresh words"), (2, 0, "u", "> fresh words\nfrom elsewhere"), (2, 1, "x", None), (None, 3, "x", "> y"), (1, None, "x", "z"), (1, 3, "a", "fresh words"), (3, 0, "u", "> nobody wrote this")]
    got = reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(9)))
    by = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert got.count() == len(rows)
    assert (by[1, 1]["parent_turn"], by[1, 1]["depth"], by[1, 1]["text"]) == (0, 1, "I agree")
    assert (by[1, 2]["parent_turn"], by[1, 2]["thread"], by[1, 2]["depth"], by[1, 2]["n_linked"]) == (1, 0, 2, 2)
    assert by[2, 0]["n_linked"] == 1 and by[2, 0]["parent_turn"] is None and by[2, 0]["text"] == "from elsewhere"
    assert by[3, 0]["n_quotes"] == 1 and by[3, 0]["n_linked"] == 0 and by[2, 1]["text"] == ""
    whole = reply_order(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert whole.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_partial_quotation(spark):
    from tachygraph.llm.quotation import reply_order

    lines, paragraphs = "first line\nsecond line\nthird line", "one two\nthree\n\nfour five six\n\nseven"
    rows = [(1, 0, "u", lines), (1, 1, "a", "> First  line\n> second line\nyes"), (1, 2, "u", "> first line\n> third line\nno"), (1, 3, "a", "> second line\n>\n> third line\nalso"), (1, 4, "a", "> third line\n> fourth line")]
    rows += [(2, 0, "u", paragraphs), (2, 1, "a", "> one two three\n>\n> four five\n> six\nyes"), (2, 2, "a", "> one two three\n>\n> seven\nno")]
    rows += [(3, 0, "u", "root"), (3, 1, "a", "alpha\nbeta\n> root\ngamma"), (3, 2, "u", "> alpha\n> beta\nyes"), (4, 0, "u", "> second line\n> third line")]
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["depth"], r["n_quotes"], r["n_linked"]) for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1] == got[1, 3] == (0, 1, 1, 1) and got[1, 2] == got[1, 4] == (None, 0, 1, 0)
    assert got[2, 1] == (0, 1, 1, 1) and got[2, 2] == (None, 0, 1, 0)
    assert got[3, 2] == (1, 2, 1, 1) and got[4, 0] == (None, 0, 1, 1)


def test_quotation_against_plain_search(spark):
    """Nested threads that quote any part: every passage finds the message that a plain search finds, and places are depth first."""
    from tachygraph.llm.quotation import GRAM, reply_order

    rng = random.Random(17)
    rows = []
    for conv in range(14):
        bodies, raw = {}, {}
        for turn in range(rng.randint(1, 25)):
            body = "\n".join(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
            parts = []
            if turn and rng.random() < 0.85:
                for _ in range(rng.randint(1, 2)):
                    source = bodies[rng.randrange(turn)].split()
                    n = rng.randint(min(GRAM, len(source)), len(source))
                    k = rng.randint(0, len(source) - n)
                    words, level = source[k : k + n], rng.choice(["> ", ">> ", "> > "])
                    cut = rng.randint(1, n)
                    parts += [level + " ".join(words[:cut]).upper()] + ([level + " ".join(words[cut:])] if cut < n else []) + [""]
            bodies[turn], raw[turn] = body, "\n".join([*parts, body])
            rows.append((conv, turn, "u", raw[turn]))
    rows.append((99, 0, "u", "> " + " ".join(bodies[0].split())))

    def norm(t):
        return " ".join(t.lower().split())

    body = {(c, t): "\n".join(x for x in text.split("\n") if not x.startswith(">")).strip() for c, t, _, text in rows}

    def holds(key, passage):
        units = [norm(x) for x in passage.split("\n") if norm(x)]
        lines = [norm(x) for x in body[key].split("\n") if norm(x)]
        paragraphs = [norm(x) for x in re.split(r"\n[ \t]*\n", body[key])]
        if norm(passage) in [norm(body[key]), *lines, *paragraphs]:
            return True
        if len(units) > 1 and any(lines[k : k + len(units)] == units for k in range(len(lines))):
            return True
        return len(norm(passage).split()) >= GRAM and f" {norm(passage)} " in f" {norm(body[key])} "

    want, parent = {}, {}
    for c, t, _, text in rows:
        runs, last = [], 0
        for at, line in enumerate(text.split("\n")):
            level = line.replace(" ", "")[: 2 if line.startswith((">>", "> >")) else 1].count(">") if line.startswith(">") else 0
            if level:
                words = line.lstrip("> ")
                if level == last:
                    runs[-1][2].append(words)
                else:
                    runs.append((level, at, [words]))
            last = level
        linked = 0
        best = None
        for level, at, lines in runs:
            near = [x for x in range(t) if (c, x) in body and holds((c, x), "\n".join(lines))]
            far = min((k for k in body if holds(k, "\n".join(lines))), default=None)
            linked += bool(near) or far is not None and far[0] != c
            if near and (best is None or (level, at) < best[:2]):
                best = (level, at, max(near))
        want[c, t] = (len(runs), linked, best[2] if best else None)
        parent[c, t] = best[2] if best else None
    children = defaultdict(list)
    for (c, t), p in parent.items():
        if p is not None:
            children[c, p].append(t)
    place = {}

    def walk(c, t, root, n):
        place[c, t] = (root, n)
        n += 1
        for x in sorted(children[c, t]):
            n = walk(c, x, root, n)
        return n

    for (c, t), p in parent.items():
        if p is None:
            walk(c, t, t, 0)
    got = {(r["conv_id"], r["turn"]): r for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r["n_quotes"], r["n_linked"], r["parent_turn"]) for k, r in got.items()} == want
    assert {k: (r["thread"], r["place"]) for k, r in got.items()} == place
    assert {k: r["text"] for k, r in got.items()} == body
    assert max(p for _, p in place.values()) > 4 and sum(w[1] for w in want.values()) > 100


def test_quotation_ties_and_hot_passages(spark):
    """Repeated rows and a passage that most messages quote."""
    from tachygraph.llm import quotation

    rows = [(c, 0, "u", "one two three four five six") for c in range(40)] + [(c, k, "u", "> two three four five six\n\nyes") for c in range(40) for k in (1, 1, 2, 9000)]
    got = quotation.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert all((r["parent_turn"], r["depth"], r["text"]) == (0, 1, "yes") for r in got if r["turn"])
    assert {(r["turn"], r["place"]) for r in got} == {(0, 0), (1, 1), (2, 2), (9000, 3)}


# 3

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((int(c) * 2 - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for r, (k, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                out.append((m.start(), r, m.end(), k))
    return sorted(out)


def test_sanitise_base(docs, empty):
    from tachygraph.llm.sanitise import personal_data, sanitised, span_text

    got = personal_data(docs)
    want = [(i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t or ""))) for i, t in pairs_of(docs, "doc_id", "text")]
    rows = got.select(F.col("doc.doc_id").alias("doc_id"), span_text("base").alias("b"))
    assert sorted(pairs_of(rows, "doc_id", "b"), key=str) == sorted(want, key=str)
    clean = {r[0]: r[1] for r in sanitised(got).select("doc.doc_id", "clean").collect()}
    assert "[EMAIL]" in clean[900_010] and "4111" not in clean[900_010]
    assert personal_data(empty).count() == 0


def test_sanitise_terms(spark):
    from tachygraph.llm.sanitise import personal_data, sanitised, span_text

    rows = [(k, f"the usual words {k} about zanzibarproject write to boss@corp.example please number {k}") for k in range(8)] + [(100 + k, f"the usual words please number {k} and about more write to") for k in range(200)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r[0]: r[1] for r in got.select("doc.doc_id", span_text("spans").alias("s")).collect()}
    text = dict(rows)
    for k in range(8):
        found = {(a.split(":")[0], text[k][int(a.split(":")[1]) : int(a.split(":")[2])]) for a in spans[k].split(",")}
        assert found == {("email", "boss@corp.example"), ("term", "zanzibarproject")}
    assert all(not spans[100 + k] for k in range(200))
    assert "zanzibar" not in sanitised(got).filter("doc.doc_id = 3").first()["clean"]


def test_sanitise_terms_need_support(spark):
    """One or two texts are no evidence, three that agree are; a class has the support that its single entities lack; the corpus' size does not count."""
    from tachygraph.llm.sanitise import personal_data, span_text

    rows = [(k, f"ask quillfeather {k} at rare@corp.example") for k in range(2)] + [(9, "quillwort writes to single@one.example")]
    rows += [(20 + k, f"write the borough desk to clerk{k}@council.example today {k}") for k in range(6)]
    rows += [(40 + k, f"the ferry {k} calls 10.20.30.{k} at night") for k in range(3)] + [(60, "the ferry is late")]
    for size in (200, 3000):
        docs = rows + [(100 + k, f"ask at usual writes the calls desk night today write to {k}") for k in range(size)]
        got = {r[0]: r[1] for r in personal_data(spark.createDataFrame(docs, "doc_id long, text string")).select("doc.doc_id", span_text("spans")).collect()}
        assert got[0] == got[1] == "email:22:39" and got[9] == "email:20:38"
        #: No two texts share an address, all share its domain.
        assert all(got[20 + k] == f"term:10:17,email:26:{26 + len(f'clerk{k}@council.example')}" for k in range(6))
        #: Three of four texts: the bound is too low.
        assert all(got[40 + k] == "ip:18:28" for k in range(3)) and got[60] == ""
        assert not any(got[100 + k] for k in range(size))


def test_sanitise_against_plain_counts(spark):
    """Spans of kind term and the clean text, against counts in plain Python over a whole table."""
    import math

    from tachygraph.llm.sanitise import CONFIDENCE, CONTEXT, KINDS as NAMES, MASKS, MIN_BITS, MIN_DISCLOSURE, REMOVE, personal_data, sanitised, span_text

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    #: Some terms that go with a domain, to differing degrees.
    planted = [(2_000_000 + 100 * d + k, f"note {k} of unit{d} and desk{d % 2} " + (f"to p{k}@org{d}.example" if k < 12 - d else "without")) for d in range(6) for k in range(12)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    rows = dict(pairs_of(docs, "doc_id", "text"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(t):
        for p in KINDS.values():
            t = re.sub(p, " ", t)
        return set(word.findall(t))

    texts = {t for t in rows.values() if t is not None}
    holds, n_et = defaultdict(set), defaultdict(set)
    for t in texts:
        for k, p in KINDS.items():
            found = list(re.finditer(p, t))
            good = {(a, b) for a, _, b, kind in base_spans(t) if kind == k}
            for i, m in enumerate(found):
                if m.span() in good:
                    entity = k + ":" + (m[0].lower() if k == "email" else m[0] if k == "ip" else re.sub("[^0-9]", "", m[0]))
                    before, after = t[found[i - 1].end() if i else 0 : m.start()], t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)]
                    before = re.sub(r"^[^\s]*", "", before[-CONTEXT:], flags=re.A) if len(before) > CONTEXT else before
                    after = re.sub(r"[^\s]+\Z", "", after[:CONTEXT], flags=re.A) if len(after) > CONTEXT else after
                    group = "class of " + k + ":" + (m[0].lower().rsplit("@", 1)[1] if k == "email" else m[0].rsplit(".", 1)[0] if k == "ip" else re.sub("[^0-9]", "", m[0])[:6])
                    for e in (entity, group):
                        holds[e].add(t)
                        for term in terms(before + " " + after):
                            n_et[e, term].add(t)
    n_t = Counter(x for t in texts for x in terms(t))
    told = {}
    for (e, x), where in n_et.items():
        n, z = n_t[x], CONFIDENCE
        p = len(where) / n
        d = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if d >= MIN_DISCLOSURE and math.log2(d / (len(holds[e]) / len(texts))) >= MIN_BITS:
            told[x] = max(d, told.get(x, 0))
    got = sanitised(personal_data(docs)).select("doc.doc_id", span_text("spans").alias("spans"), "clean").collect()
    assert len(got) == len(rows) and len(set(told.values())) > 3 and all(n_t[x] >= 3 for x in told)
    for r in got:
        t = rows[r["doc_id"]] or ""
        base = base_spans(t)
        mine = terms(t)
        more = [(m.start(), 4, m.end(), "term") for m in word.finditer(t) if m[0] in told and m[0] in mine and not any(m.start() < b and a < m.end() for a, _, b, _ in base)]
        spans = sorted(base + more)
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        out, p = "", 0
        for a, rank, b, k in spans:
            if a >= p:
                out += t[p:a] + (MASKS[k] if rank < len(NAMES) else "" if told[t[a:b]] >= REMOVE else "[NUMBER]" if t[a:b].isascii() and t[a:b].isdigit() else "[WORD]")
            p = max(p, b)
        assert r["clean"] == out + t[p:]


def test_sanitise_very_long_text(spark):
    """Twenty thousand matches in one text stay cheap."""
    import time

    from tachygraph.llm.sanitise import personal_data, sanitised, span_text

    text = " ".join(f"user{k}@mail{k % 9}.example.com 10.0.{k % 250}.{k % 200}" for k in range(20_000))
    began = time.time()
    got = personal_data(spark.createDataFrame([(1, text), (2, "1" * 300_000), (3, "a" * 300_000 + "@")], "doc_id long, text string"))
    clean = {r[0]: r[1] for r in sanitised(got).select("doc.doc_id", "clean").collect()}
    assert clean[1] == " ".join(["[EMAIL] [IP]"] * 20_000) and clean[2] == "1" * 300_000
    rows = dict(pairs_of(got.select(F.col("doc.doc_id").alias("doc_id"), span_text("base").alias("b")), "doc_id", "b"))
    assert rows[1] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(text)) and rows[2] == rows[3] == ""
    assert time.time() - began < 60


@pytest.mark.parametrize("seed", range(3))
def test_spans_property(spark, seed):
    from tachygraph.llm.sanitise import personal_data, span_text

    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice("a.@-_1 25+().\né漢") for _ in range(rng.randint(0, 400)))) for k in range(150)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc.doc_id").alias("doc_id"), span_text("base").alias("b"))
    assert dict(pairs_of(got, "doc_id", "b")) == {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)) for i, t in rows}


# 4


def test_shards(docs, empty):
    from tachygraph.llm.shards import minimax_shards

    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs_of(docs, "doc_id", "text"))
    for block in (7, 100_000):
        got = minimax_shards(docs, block=block).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        slots, load = defaultdict(list), Counter()
        for r in got:
            slots[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
        group = defaultdict(int)
        for _, t in pairs_of(docs, "doc_id", "text"):
            group["" if t is None else hashlib.sha256(t.encode()).hexdigest()] += len((t or "").encode()) + 1
        sizes = [group[k] for k in sorted(group)]

        def need(c, sizes=sizes):
            n, s = 1, 0
            for x in sizes:
                if s + x > c:
                    n, s = n + 1, 0
                s += x
            return n

        best = next(c for c in range(max(sizes), sum(sizes) + 1, 1) if need(c) <= 16)
        assert max(load.values()) == best
    assert minimax_shards(empty).count() == 0


# 5


def test_packing(docs, empty):
    from tachygraph.llm.packing import best_fit, pack

    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(0, 60)
        sizes = sorted((rng.randint(0, 100) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randint(-1, 4) for _ in range(n)], [rng.randint(-1, 20) for _ in range(n)]
        bins, want = [], []
        for size, s, c in zip(sizes, sources, clusters):
            fit = [k for k, b in enumerate(bins) if b[0] >= size and not (s >= 0 and s in b[1]) and not (c >= 0 and c in b[2])]
            if fit:
                k = min(fit, key=lambda k: (bins[k][0], k))
            else:
                bins.append([100, set(), set()])
                k = len(bins) - 1
            bins[k][0] -= size
            bins[k][1].add(s)
            bins[k][2].add(c)
            want.append(k)
        assert pack(sizes, sources, clusters, 100) == want
    got = best_fit(docs, capacity=500).collect()
    load, sources, words = Counter(), defaultdict(list), Counter()
    source = {i: s for i, s in pairs_of(docs, "doc_id", "source")}
    for r in got:
        load[r["bin"]] += r["n_words"]
        words[r["doc_id"]] += r["n_words"]
        if source.get(r["doc_id"]) and r["n_words"] < 500:
            sources[r["bin"]].append(source[r["doc_id"]])
    assert max(load.values()) <= 500 and all(len(v) == len(set(v)) for v in sources.values())
    want = Counter()
    for i, t in pairs_of(docs, "doc_id", "text"):
        want[i] += len(WORD.findall(t or ""))
    assert +words == +want
    assert best_fit(empty).count() == 0


def test_packing_rounds(spark, docs, empty):
    """Over a whole table: every part once, no bin too full, no two of a source or cluster in a bin, and as few bins as one unit gives."""
    from tachygraph.llm.packing import best_fit

    whole = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    one = best_fit(whole, unit_rows=10**9).select("bin").distinct().count()
    assert best_fit(whole).select("bin").distinct().count() <= one + 1
    got = best_fit(docs, capacity=300, unit_rows=40).collect()
    rows = {}
    for i, s, t in pairs_of(docs, "doc_id", "source", "text"):
        rows[i] = (s, None if t is None else " ".join(t.translate(LOW).split(" ")).strip(" "))
    counts = Counter((r["doc_id"], r["part"]) for r in got)
    want = Counter((i, k) for i, t in pairs_of(docs, "doc_id", "text") for k in range(max(1, -(-len(WORD.findall(t or "")) // 300))))
    assert counts == want
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r)
    for members in bins.values():
        assert sum(r["n_words"] for r in members) + members[0]["bin_free"] == 300 and members[0]["bin_free"] >= 0
        sources = [rows[r["doc_id"]][0] for r in members if rows[r["doc_id"]][0] is not None]
        texts = [re.sub(r"[\x20\x09-\x0D]+", " ", rows[r["doc_id"]][1].strip(" ")) for r in members if rows[r["doc_id"]][1] is not None]
        assert len(sources) == len(set(sources)) and len(texts) == len(set(texts))
    assert best_fit(empty, unit_rows=1).count() == 0


# 6


def test_decontamination(docs, empty, bench_items):
    from tachygraph.llm.decontam import contamination, keep_clean

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in pairs_of(bench_items, "item_id", "text"):
        w = word.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    want = []
    for i, t in pairs_of(docs, "doc_id", "text"):
        w, hit, items = word.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = contamination(docs, bench_items).select(F.col("doc.doc_id").alias("doc_id"), F.col("n_words"), "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(pairs_of(got, *got.columns), key=str) == sorted(want, key=str)
    assert any(x[5] for x in want)
    clean = keep_clean(docs, bench_items)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    assert contamination(empty, bench_items).count() == 0
    assert contamination(docs, bench_items.limit(0)).filter("contaminated").count() == 0


def test_proximity_against_plain_search(spark):
    """Items with a proximity match: a window of which two probe terms stand nearly at their distance, and most of whose words are there."""
    from tachygraph.llm.decontam import NEAR_PERCENT, PROBES, SLOP, candidates, contamination, index, item_words, probes, term_counts

    rng = random.Random(23)
    vocabulary = [f"t{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 13, 20])))) for k in range(30)]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["extra", part[at]], [rng.choice(vocabulary)]])
                part = part or ["x"]
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((k, " ".join(words)))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    n = Counter(w for t in {t for _, t in rows} for w in t.split())
    want = {}
    for i, t in rows:
        w, found = t.split(), set()
        for item, text in items:
            x = text.split()
            wins = {k: x[k : k + 13] for k in range(max(1, len(x) - 12))}
            places = {k + o for k, win in wins.items() for _, _, o in sorted((n[v], v, o) for o, v in enumerate(win) if n[v])[:PROBES]}
            begins = [(at - p, p) for p in places for at, v in enumerate(w) if v == x[p]]
            for b, p in begins:
                if len(x) == 1 or any(abs(b - c) <= SLOP and p != q and abs(p - q) < 13 for c, q in begins):
                    for k, win in wins.items():
                        if k <= p < k + len(win) and b + k + len(win) > 0:
                            place = w[max(b + k - SLOP, 0) : max(0, b + k + len(win) + SLOP)]
                            if 100 * len(set(place) & set(win)) >= NEAR_PERCENT * len(set(win)):
                                found.add(item)
        want[i] = len(found)
    rows_n = contamination(docs, bench).select("doc.doc_id", "n_near", "n_items").collect()
    assert {r["doc_id"]: r["n_near"] for r in rows_n} == want
    assert all(r["n_near"] >= r["n_items"] for r in rows_n) and any(r["n_near"] > r["n_items"] for r in rows_n)
    one = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "alpha x x beta gamma delta x"), (2, "alpha beta gamma delta"), (3, "delta only")], "doc_id long, text string")
    its = item_words(one)
    rare = probes(its, term_counts(texts, its.select(F.explode("words").alias("term")).distinct()))
    posts = index(texts, rare.select("term").distinct())
    got = {(r["begin"], len(r["ps"])) for r in candidates(posts, rare, slop=0).collect()}
    assert got == {(2, 3), (0, 4)}
    wide = candidates(posts, rare, slop=5)
    assert wide.select("tid").distinct().count() == 2 and (0, 1) in {(r["begin"], len(r["ps"])) for r in wide.collect()}


@pytest.mark.parametrize("size", [400, 20_000])
def test_proximity_recall(spark, size):
    """Items that stand in one document each with one or two words replaced are found, as a search over all places would."""
    from tachygraph.llm.decontam import contamination

    rng = random.Random(size)
    vocabulary = [f"t{k}" for k in range(size)]
    items = [(k, " ".join(rng.sample(vocabulary, 13))) for k in range(200)]
    rows = []
    for k, t in items:
        for replaced in (1, 2):
            words = t.split()
            for n, at in enumerate(rng.sample(range(13), replaced)):
                words[at] = f"new{k}x{n}"
            rows.append((2 * k + replaced - 1, " ".join([*rng.choices(vocabulary, k=20), *words, *rng.choices(vocabulary, k=20)])))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in contamination(docs, bench).select("doc.doc_id", "n_near").collect()}
    for replaced in (1, 2):
        assert sum(got[2 * k + replaced - 1] >= 1 for k in range(200)) >= 0.9 * 200


def test_letters_beyond_ascii_keep_their_case(spark):
    """The lower case of a capital sigma hangs on what stands around it, so only A-Z is folded, in documents and items alike."""
    from tachygraph.llm.decontam import contamination

    items = [(1, "ΟΔΟΣ"), (2, "ΟΔΟΣ.ΑΘΗΝΑ"), (3, "İstanbul:ÄRGER Street"), (4, "οδος")]
    rows = [(k, t) for k, t in enumerate(["ΟΔΟΣ.ΑΘΗΝΑ", "ΟΔΟΣ ΑΘΗΝΑ", "'ΟΔΟΣ':x", "οδος", "a İstanbul ÄRGER sTREET", "a istanbul ärger street", "ΟΔΟΣΑ"])]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in contamination(docs, bench).select("doc.doc_id", "n_hit", "n_items").collect()}
    assert got == {0: (2, 2), 1: (2, 2), 2: (1, 1), 3: (1, 1), 4: (3, 1), 5: (0, 0), 6: (0, 0)}


def test_texts_of_one_hash_are_told_apart(spark):
    """Two texts that share the index' hash each get their own verdict."""
    from tachygraph.llm.decontam import confirmed

    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    found = docs.select(F.xxhash64("text").alias("tid"), F.expr("array(struct(7L as item_id, 0 as begin, array(0) as ps, array('one', 'two') as words), struct(8L as item_id, 1 as begin, array(0, 1) as ps, array('one', 'two') as words))").alias("found"))
    got = confirmed(docs, found).collect()
    assert [(r["n_hit"], r["n_items"], r["sha"]) for r in got] == [(2, 1, hashlib.sha256(b"one two three four").hexdigest())]


# 7


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    """Rows that share an id are one node."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def check_near(df):
    from tachygraph.llm.near_dedup import keep_one, near_duplicates

    rows = pairs_of(df, "doc_id", "text")
    component = brute_components(rows)
    want = [(i, len(shingles(t)), component.get(i), i is None or component[i] == i) for i, t in rows]
    got = near_duplicates(df)
    assert sorted(pairs_of(got, "doc_id", "n_shingles", "component_id", "kept"), key=str) == sorted(want, key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns and kept.count() == sum(x[3] for x in want)


def test_near_duplicates(docs, empty):
    check_near(docs)
    from tachygraph.llm.near_dedup import near_duplicates

    assert near_duplicates(empty).count() == 0


def test_keep_one_judges_rows(spark):
    """Repeated rows go to one; a clean text stays if another text of its doc_id goes."""
    from corpus_pipeline import near_dedup
    from tachygraph.llm.near_dedup import keep_one

    rng = random.Random(8)
    one, two, three, four = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(1, one, "x"), (5, one, "x"), (5, two, "x"), (7, three, "x"), (7, three, "x"), (None, four, "b"), (None, four, "a"), (8, None, "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = [(1, one, "x"), (5, two, "x"), (7, three, "x"), (None, four, "a"), (8, None, "x")]
    assert sorted(map(tuple, near_dedup(spark, df, SF).collect()), key=str) == sorted(once, key=str)
    assert sorted(map(tuple, keep_one(df).collect()), key=str) == sorted([x for x in rows if x[:2] != (5, one)], key=str)


def test_large_family_with_strangers(spark):
    """Members of a large family, a second family near its buckets, and strangers: the components are those of all pairs."""
    rng = random.Random(29)
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 5, 6])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append(" ".join(text))
    for k in range(25):
        rows.append(" ".join(base[: 60 + 2 * k] + [rng.choice(vocabulary) for _ in range(12)]))
    rng.shuffle(rows)
    check_near(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def test_rows_that_share_an_id_are_one_node(spark):
    from tachygraph.llm.near_dedup import near_duplicates

    rng = random.Random(18)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4))
    rows = [(0, a), (1, a), (1, b), (3, b), (4, c), (4, d), (4, None), (6, d + " more"), (9, "solo words"), (9, ""), (None, a), (11, None)]
    component = brute_components(rows)
    want = [(i, len(shingles(t)), component.get(i), i is None or component[i] == i) for i, t in rows]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(pairs_of(got, "doc_id", "n_shingles", "component_id", "kept"), key=str) == sorted(want, key=str)
    assert component[1] == component[3] == 0 and component[6] == 4


def test_near_duplicate_families(spark):
    """Families of copies at all distances from the limit, in chains and stars."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
            if rng.random() < 0.3:
                base = text
    rng.shuffle(rows)
    check_near(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"))


# 8


def test_lexicon_against_edit_distance():
    from tachygraph.llm.lexicon import Lexicon

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row

    rng = random.Random(12)
    terms = [("idiotic", False, 3.0, True), ("worthless", False, 2.0, True), ("lostra", True, 4.0, True), ("scum", False, 5.0, True), ("los", False, 6.0, True), ("vequ", True, 7.0, True), ("scums", False, 9.0, False)]
    lex = Lexicon(terms, frozenset(["lostre"]))
    for _ in range(6000):
        term = rng.choice(terms)[0]
        word = list(term + ("".join(rng.choice("abst") for _ in range(rng.randint(0, 3))) if rng.random() < 0.4 else ""))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(word))
            word[k : k + 1] = rng.choice([[], [rng.choice("aiost")], [word[k], rng.choice("aiost")]])
            if not word:
                word = ["a"]
        word = "".join(word)
        want = [(t, w) for t, stem, w, one_edit in terms if one_edit and len(t) >= (6 if stem else 4) and word != "lostre" and (min(distance(t, word)) if stem else distance(t, word)[-1]) == 1]
        got = lex.fuzzy(word)
        assert (got[0] if got else None) == (max(want, key=lambda x: x[1])[0] if want else None), word
    assert lex.exact("lostraschaft")[0] == "lostra" and lex.exact("scumx") is None


def test_toxicity(spark, docs, empty):
    from tachygraph.llm.toxicity import scored

    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = scored(d, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    one, zero = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))
    assert auc > 0.8 and sum(r["predicted"] and not r["toxic"] for r in got) <= 0.02 * len(got)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (900_001, 0, None)], labels.schema))
    rows = scored(docs, odd).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert scored(empty, labels).count() == 0 and scored(d, labels.limit(0)).filter("predicted = 1").count() == 0


def test_toxicity_context_and_spelling(spark):
    """Clean, quoted, misspelled and open abuse of equal length stand in that order; every row's score is that of a plain scorer."""
    import math

    from tachygraph.llm.toxicity import ADDRESSING, FUZZY, REPORTING, WINDOW, quoted_places, scored, train

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = train(docs, labels)
    terms, never, weights = model
    words = [t for t, stem, _, _ in terms if not stem and len(t) >= 5 and t.isascii()][:3]
    assert len(words) == 3
    filler = "plans for another library and how it will be paid for by everyone next to"
    made = {"clean": "x x x x", "quoted": 'said "' + " ".join(words) + '"', "misspelled": "x " + " ".join(w[:2] + "q" + w[3:] for w in words), "open": "x " + " ".join(words), "addressed": "you " + " ".join(words)}
    own = spark.createDataFrame([(k, f"{filler} {v}") for k, v in enumerate(made.values())], "doc_id long, text string")
    got = dict(zip(made, (r["score"] for r in scored(own, labels, model=model).orderBy("doc_id").collect())))
    assert got["clean"] < got["quoted"] < got["misspelled"] < got["open"] <= got["addressed"] and got["open"] >= 0.7 and got["quoted"] < 0.5
    #: One open insult in ordinary prose is enough; the same quoted or reported is not.
    single = {k: f"{filler} {v} the end of the week" for k, v in {"one": words[0], "report": f"said {words[0]}", "mark": f'"{words[0]}"', "near": words[0][:2] + "q" + words[0][3:]}.items()}
    one = dict(zip(single, (r["score"] for r in scored(spark.createDataFrame(list(enumerate(single.values())), "doc_id long, text string"), labels, model=model).orderBy("doc_id").collect())))
    assert one["one"] >= 0.7 and one["one"] > one["near"] > max(one["report"], one["mark"]) and max(one["report"], one["mark"]) < 0.3

    def bare(w):
        return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", w)

    def near(term, w, stem):
        row = list(range(len(w) + 1))
        for i, x in enumerate(term, 1):
            new = [i]
            for j, y in enumerate(w, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return (min(row) if stem else row[-1]) == 1

    def find(w):
        w = bare(w)
        if len(w) <= 2:
            return None
        exact = [x for t, stem, x, _ in terms if w == t and not stem or stem and w.startswith(t)]
        if exact:
            return True, max(exact)
        fuzzy = [x for t, stem, x, one_edit in terms if one_edit and w not in never and len(t) >= (6 if stem else 4) and near(t, w, stem)]
        return (False, max(fuzzy)) if fuzzy else None

    known = {}
    own = own.withColumn("doc_id", F.col("doc_id") + 10_000_000)
    both = docs.select("doc_id", "text").unionByName(own)
    scores = dict(pairs_of(scored(both, labels, model=model), "doc_id", "score"))
    rows = [(i, t) for i, t in pairs_of(both, "doc_id", "text") if t and len(t) < 1500 or i >= 10_000_000]
    assert len(rows) > 100
    for i, text in rows:
        w = text.lower().split()
        places, hits = quoted_places(w), []
        for k, x in enumerate(w):
            if x not in known:
                known[x] = find(x)
            if known[x]:
                around = set(w[max(0, k - WINDOW) : k + WINDOW + 1])
                hits.append((x, *known[x], k in places or bool(around & REPORTING), bool(around & ADDRESSING)))
        free = [h for h in hits if not h[3]]
        strength = {h[0]: h[2] * (1 if h[1] else FUZZY) for h in free}
        top = sorted((v * v / 10 for v in strength.values()), reverse=True)
        sums = [sum(h[2] * (1 if h[1] else FUZZY) for h in hits), sum(h[1] for h in hits), len(free), sum(h[1] for h in free), sum(h[4] for h in free)]
        x = [math.log1p(s) for s in sums] + [top[0] if top else 0, sum(top[1:4]), min(20, 100 * len(free) / max(len(w), 1)), math.log1p(len(w)), 1]
        z = max(-30, min(30, sum(a * b for a, b in zip(x, weights))))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), (text, hits)
    assert sum(v is not None and not v[0] for v in known.values()) > 2


def test_quoted_places():
    from tachygraph.llm.toxicity import quoted_places

    words = 'he "said so" and "then. ' + "x " * 70 + "'one' «deux trois», end\""
    words = words.split()
    assert {words[i] for i in quoted_places(words)} == {'"said', 'so"', "'one'", "«deux", "trois»,"}


# 9


def test_html_marginals():
    """Messages give the marginals that summing over all labellings gives."""
    import itertools
    import math

    from tachygraph.llm.dom import Node
    from tachygraph.llm.html_extract import marginals

    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(1, 9)
        nodes = [Node("x", "", -1 if k == 0 else rng.randrange(k)) for k in range(n)]
        own = [rng.uniform(-3, 3) for _ in nodes]
        tables = [tuple(rng.uniform(0.1, 2) for _ in range(4)) for _ in nodes]
        total = [[0.0, 0.0] for _ in nodes]
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(o * v for o, v in zip(own, y)))
            for k in range(1, n):
                p *= tables[nodes[k].parent][2 * y[nodes[k].parent] + y[k]]
            for k in range(n):
                total[k][y[k]] += p
        assert marginals(nodes, own, tables) == pytest.approx([math.log(b / a) for a, b in total])


def test_html_extraction(spark):
    from tachygraph.llm.html_extract import extracted

    page = """<html><body><div class="cookie-notice"><p>We use cookies on this site.</p></div><nav><a href=a>Home</a></nav><header>Site name</header>
    <div class="post-content"><h1>A &amp; B</h1><p>First   line,<br>second &eacute; one.<p>Unclosed <b>bold</b> text.<div class="ad-box">Buy now</div><script>var x = "<p>no</p>"</script><p>Last one.</div>
    <div id="comments"><p>Nice post!</p></div><form><label>Search</label></form><aside>Other things to read</aside><footer>&copy; 2020</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "just text < 5 & more"), (3, "w", "<p"), (4, "x", "<div>" * 3000 + "deep"), (5, "y", "<!-- open <p>x</p>")]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r["text"] for r in got if r["page_id"] == 1) == "A & B\n\nFirst line, second é one.\n\nUnclosed bold text.\n\nLast one."
    assert next(r["text"] for r in got if r["page_id"] == 2) == ""


def test_html_by_structure(spark):
    """Comments, a sign-up box and an address without telling names."""
    from tachygraph.llm.html_extract import extracted

    text = "The committee met again on Thursday, and most members spoke about the new library, its cost and its plan."
    rows = [
        (1, f'<body><main><h1>Title here</h1><p>{text}</p><p>{text}</p></main><section class="responses"><h3>Three said</h3><div class="r1"><span>Ann</span><p>I liked this, and you?</p></div><div class="r1"><span>Bob</span><p>So did I, thank you.</p></div></section></body>'),
        (2, f'<body><article><h1>Title here</h1><p>{text}</p><address>12 Long Street, Oldtown</address><p>{text}</p></article><div><h3>Stay in touch</h3><p>Get our letter each week, free.</p><input name="e"><button>Go</button></div></body>'),
        (3, f'<body><div><h1>Title here</h1><p>{text}</p><p>{text}</p><p>{text}</p></div><section><h3>What people think</h3><div class="zz"><span>Ann</span><p>I liked this, and you?</p></div><div class="zz"><span>Bob</span><p>So did I, thank you.</p></div></section></body>'),
    ]
    item = lambda who, what: f'<div class="c-item"><div>{who}</div><p>{what}</p></div>'
    rows += [
        (4, f"<body><div><h2>Bridge</h2><div>{text}</div><div>Short.</div></div></body>"),
        (5, f'<body><div class="nav"><a href="x">Home</a></div><div><h2>Bridge</h2><div>{text}</div><div>Short.</div><div>{text}</div></div><div class="footer">&copy; 2020 Us</div></body>'),
        (6, f'<body><article><h1>Title</h1><p>{text}</p><p>{text}</p><div class="c-list">{item("Ann", "I liked this, and you?")}{item("Bob", "So did I, but not all of it, thank you.")}</div></article></body>'),
        (7, f'<body><article><h1>Title</h1><div class="step"><h3>First</h3><p>{text}</p></div><div class="step"><h3>Then</h3><p>Rest.</p></div></article></body>'),
    ]
    got = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    assert got[4] == f"Bridge\n\n{text}\n\nShort." and got[5] == f"Bridge\n\n{text}\n\nShort.\n\n{text}"
    assert got[6] == f"Title\n\n{text}\n\n{text}" and got[7] == f"Title\n\nFirst\n\n{text}\n\nThen\n\nRest."
    assert got[1] == f"Title here\n\n{text}\n\n{text}"
    assert got[2] == f"Title here\n\n{text}\n\n12 Long Street, Oldtown\n\n{text}"
    assert got[3] == f"Title here\n\n{text}\n\n{text}\n\n{text}"


def test_html_on_given_pages(spark):
    """Every page of a table against a reader that knows the article's tag; an empty table."""
    from html import unescape

    from tachygraph.llm.html_extract import extracted

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extracted(pages).collect()}
    assert len(got) == pages.count()
    for i, html in pairs_of(pages, "page_id", "html"):
        inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|em|strong|a|span)[^>]*>", "", x))).split()) for x in re.split(r"</?(?:p|h\d|li|ul|div)\b[^>]*>", inner)]
        assert got[i] == "\n\n".join(x for x in blocks if x)
    assert extracted(pages.limit(0)).count() == 0


def test_html_on_made_pages():
    from tachygraph.llm.html_extract import labelled_nodes, marginals, trained

    model, rng, good, n = trained(), random.Random(77), 0, 0
    for _ in range(100):
        nodes, y = labelled_nodes(rng)
        odds = marginals(nodes, *model.potentials(nodes))
        runs = [(o >= 0) == bool(v) for node, o, v in zip(nodes, odds, y) if node.text is not None]
        good, n = good + sum(runs), n + len(runs)
    assert good / n > 0.95


# 10


def test_line_dedup(docs, empty):
    from tachygraph.llm.line_dedup import drop_lines

    rows = pairs_of(docs, "doc_id", "source", "text")
    pages = defaultdict(list)
    for _, s, t in rows:
        if t is not None:
            pages[s].append(t)
    bad = {}
    for s, texts in pages.items():
        n = Counter(x for t in texts for x in {x.strip(" ") for x in t.split("\n")} if x)
        bad[s] = {x for x, k in n.items() if k >= 2 and k > 0.1 * len(texts)}
    want = []
    for i, s, t in rows:
        lines = None if t is None else t.split("\n")
        left = None if t is None else [x for x in lines if not x.strip(" ") or x.strip(" ") not in bad.get(s, ())]
        want.append((i, s, None if t is None else "\n".join(left), 0 if t is None else len(lines) - len(left)))
    got = drop_lines(docs, "source", max_ratio=0.1)
    assert sorted(pairs_of(got.select("doc_id", "source", "text", got.columns[-1]).toDF("doc_id", "source", "text", "n"), "doc_id", "source", "text", "n"), key=str) == sorted(want, key=str)
    assert sum(x[3] for x in want) > 0 and drop_lines(empty, "source").count() == 0


def test_line_dedup_of_small_hosts(spark):
    """The dealt ratio at every size: two pages that share a line lose it, one page keeps all its lines, copies are pages each."""
    from tachygraph.llm.line_dedup import drop_lines

    rows = [("two", "menu\nfirst"), ("two", " menu \nsecond\nmenu"), ("one", "menu\nmenu\nalone"), ("copies", "same\ntext"), ("copies", "same\ntext"), (None, "x"), (None, "x\ny"), ("null", None)]
    rows += [("large", f"page {k}\n" + ("footer\n" if k < 3 else "") + ("rare" if k < 2 else "z")) for k in range(100)]
    got = sorted(map(tuple, drop_lines(spark.createDataFrame(rows, "host string, text string"), "host").collect()), key=str)
    assert [r for r in got if r[0] == "two"] == [("two", "first", 1), ("two", "second", 2)]
    assert [r for r in got if r[0] == "one"] == [("one", "menu\nmenu\nalone", 0)]
    assert [r for r in got if r[0] == "copies"] == [("copies", "", 2), ("copies", "", 2)]
    assert [r for r in got if r[0] is None] == [(None, "", 1), (None, "y", 1)]
    assert [r for r in got if r[0] == "null"] == [("null", None, 0)]
    large = [r[1] for r in got if r[0] == "large"]
    #: Three of a hundred are above 2 %, two are not.
    assert not any("footer" in t for t in large) and sum("rare" in t for t in large) == 2 and not any("z" in t for t in large)


# the ways beyond a broadcast


@pytest.mark.parametrize("test", [test_sanitise_terms, test_quotation, test_near_duplicate_families])
def test_without_broadcast(spark, monkeypatch, test):
    from tachygraph.llm import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("test", [test_decontamination, test_line_dedup])
def test_tables_without_broadcast(spark, monkeypatch, docs, empty, bench_items, test):
    from tachygraph.llm import scratch

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    test(docs, empty, bench_items) if test is test_decontamination else test(docs, empty)
