"""Base spans against plain expressions; and the bootstrapping on a corpus with telling contexts."""

import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def listed(spans):
    return ",".join(f"{s.kind}:{s.at}:{s.to}" for s in spans)


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "x.y%z+1@d-e.f.g", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0199", "+", "@", ".", "-", " ", "é", "😀", "_", "7", "\n", "word", "(", "+49 30 1234567"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    texts += ["x" * 3000, "1" * 5000, "a." * 3000 + "@" + "c." * 3000, "1.2.3." * 2000, None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.base_spans(df).collect():
        spans = sorted((x.at, x.k, x.kind, x.to) for x in r.base)
        assert ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_addresses_with_zero_parts(spark):
    bits = ["10.0.0.1", "0.0.0.0", "1.2.3.000", "192.168.00.1", "00010.1.1.0255", "1.0.0.256", "1.00300.0.0", " ", ".", "word", "0"]
    rng = random.Random(6)
    texts = bits + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(300)] + ["0" * 3000 + ".0.0.1", "1.2.3." + "0" * 3000 + "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.base_spans(df).collect():
        assert ",".join(f"{x.kind}:{x.at}:{x.to}" for x in sorted(r.base, key=lambda x: (x.at, x.k))) == brute(texts[r.doc_id]), texts[r.doc_id]


AT, DOT, WS = r"[(\[{] ?(?:at|AT|@) ?[)\]}]", r"[(\[{] ?(?:dot|DOT|\.) ?[)\]}]", "[\x20\x09-\x0D]"
RUN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?: ?(?:@|{AT}) ?[A-Za-z0-9-]+(?: ?(?:\.|{DOT}| dot ) ?[A-Za-z0-9-]+)*| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)"
    r"|(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[ ./:,_()-]{0,2}[0-9])+"
)


def kinds_of(value):
    n = len(re.sub("[^0-9]", "", value))
    out = ["email"] if re.search(rf"@|{AT}| at ", value) else []
    out += ["ip"] if re.fullmatch(r"[0-9]{1,3}(?:[ .,:_-]{1,2}[0-9]{1,3}){3}", value) else []
    out += ["card"] if 12 <= n <= 19 and re.fullmatch(r"[ 0-9./_-]+", value) else []
    return out + (["phone"] if 7 <= n <= 15 and re.fullmatch(r"[ 0-9()./+-]+", value) else [])


def contexts(text, found, k):
    """Patterns of the k-th of a list of spans (start, end): whole words up to its neighbours in the list."""
    before = text[found[k - 1][1] if k else 0 : found[k][0]]
    after = text[found[k][1] : found[k + 1][0] if k + 1 < len(found) else len(text)]
    plain = lambda w: re.sub("[0-9]", "0", w.lower())
    words = [w for w in re.split(f"{WS}+", before) if w]
    whole = len(words) > 1
    left, left2 = plain(words[-1]) if words else "", plain(" ".join(words[-2:])) if whole else ""
    rest = re.split(f"{WS}+", after, maxsplit=1)
    tail = [w for w in re.split(f"{WS}+", rest[1]) if w] if len(rest) > 1 else []
    right = plain(tail[0]) if tail else ""
    return {f"L {left}", f"R {right}", f"LL {left2}", f"LR _ {left} _ {right}"}


def says(pattern):
    return re.match("^[LR]{1,2} .*[^ _]", pattern)


def bootstrapped(texts):
    """Spans of every text by the plain method."""
    seeds, edges, runs, bases = {}, {}, [], []
    for text in texts:
        text = text or ""
        base = []
        for kind, pattern in BASE.items():
            every = [m.span() for m in re.finditer(pattern, text)]
            listed = [x.split(":") for x in brute(text).split(",") if x]
            good = {(int(a), int(b)) for k, a, b in listed if k == kind}
            for k, span in enumerate(every):
                if span in good:
                    base.append((span[0], list(BASE).index(kind), kind, span[1]))
                    for p in filter(says, contexts(text, every, k)):
                        seeds.setdefault((p, kind), set()).add(text[slice(*span)])
        every = [m.span() for m in RUN.finditer(text)]
        mine = []
        for k, (a, b) in enumerate(every):
            if kinds_of(text[a:b]) and all(b <= x[0] or a >= x[3] for x in base):
                mine.append((a, b))
                for p in filter(says, contexts(text, every, k)):
                    for kind in kinds_of(text[a:b]):
                        edges.setdefault((text[a:b], kind), set()).add(p)
        runs.append(mine)
        bases.append(base)
    accepted = {}
    while True:
        good = {key: set(values) for key, values in seeds.items()}
        for (value, kind), patterns in edges.items():
            if accepted.get(value) == kind:
                for p in patterns:
                    good.setdefault((p, kind), set()).add(value)
        still = {}
        for (value, _), patterns in edges.items():
            if value not in accepted:
                for p in patterns:
                    still.setdefault(p, set()).add(value)
        known = {}
        for (p, _), values in good.items():
            known[p] = known.get(p, 0) + len(values)
        conf = {(p, kind): len(v) / (known[p] + math.log2(len(still.get(p, ())) + 1) + 1) for (p, kind), v in good.items() if len(v) >= pii.MIN_SEEDS}
        best = {}
        for (value, kind), patterns in edges.items():
            if value not in accepted:
                score = round(1 - math.prod(1 - conf[p, kind] for p in patterns if (p, kind) in conf), 9)
                if score >= pii.ACCEPT:
                    best[value] = max(best.get(value, (0, "")), (score, kind))
        if not best:
            break
        accepted |= {value: kind for value, (_, kind) in best.items()}
    out = []
    for text, base, mine in zip(texts, bases, runs, strict=True):
        more = [(a, list(BASE).index(accepted[text[a:b]]), accepted[text[a:b]], b) for a, b in mine if text[a:b] in accepted]
        out.append(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(base + more)))
    return out


def corpus(seed):
    """Texts with seeds and disguised identifiers in telling contexts, decoys in others; and the disguised ones."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    filler = lambda: " ".join(rng.choice("the a of and day sun river old".split()) for _ in range(rng.randrange(0, 5)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    telling = {"email": ("write to address", "for details"), "phone": ("please ring number", "after lunch"), "ip": ("login from host", "was refused")}
    plain = {"email": lambda: f"{name()}@{name()}.org", "phone": lambda: f"+1 {digits(3)} {digits(3)} {digits(4)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    disguised = {
        "email": lambda: rng.choice([f"{name()}(at){name()}.org", f"{name()} at {name()} dot org", f"{name()} [at] {name()}.net", f"{name()}@localhost"]),
        "phone": lambda: rng.choice([f"{digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(4)}"]),
        "ip": lambda: rng.choice([",".join(str(rng.randrange(256)) for _ in range(4)), ":".join(str(rng.randrange(256)) for _ in range(4))]),
    }
    texts, hidden = [], []
    for k in range(150):
        kind = rng.choice(list(telling))
        left, right = telling[kind]
        if k % 3:
            texts.append(f"{filler()} {left} {plain[kind]()} {right} {filler()}")
        else:
            value = disguised[kind]()
            text = f"{filler()} {left} {value} {right} {filler()}"
            hidden.append((len(texts), kind, text.index(value), text.index(value) + len(value)))
            texts.append(text)
    texts += [f"{filler()} invoice {digits(3)} {digits(4)} of {2000 + k} {filler()} meet at noon dot" for k in range(30)]
    texts += [f"{plain['email']()}, {plain['ip']()} {plain['phone']()}" for _ in range(5)] + [None, "", "1,2,3,4"]
    return texts, hidden


def test_bootstrapping_equals_a_plain_version_and_finds_disguised_identifiers(spark):
    for seed in (1, 2):
        texts, hidden = corpus(seed)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: listed(r.spans) for r in pii.find_pii(df).collect()}
        want = bootstrapped(texts)
        assert [got[k] for k in range(len(texts))] == want
        found = {(k, kind, a, b) for k, spans in got.items() for kind, a, b in (x.split(":") for x in spans.split(",") if x)} - {(k, *x.split(":")) for k, t in enumerate(texts) for x in brute(t).split(",") if x}
        found = {(k, kind, int(a), int(b)) for k, kind, a, b in found}
        recall, precision = len(found & set(hidden)) / len(hidden), len(found & set(hidden)) / max(1, len(found))
        print(f"seed {seed}: recall {recall:.3f}, precision {precision:.3f} of {len(hidden)} disguised identifiers")
        assert recall >= 0.9 and precision >= 0.95


def test_contexts_reveal_unseen_identifiers(spark):
    texts = [f"please send your message to mail address user{k}@site{k}.org as soon as you can" for k in range(20)]
    texts += ["please send your message to mail address hidden(at)site.net as soon as you can"]
    texts += [f"the serial number was 99{k}12345678 on that day" for k in range(5)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    for k in range(20):
        assert listed(got[k].spans) == listed(got[k].base) == brute(texts[k])
    at = texts[20].index("hidden")
    assert listed(got[20].spans) == f"email:{at}:{at + len('hidden(at)site.net')}" and not got[20].base
    assert not any(got[k].spans for k in range(21, 26))


def test_running_sums(spark):
    rng = random.Random(2)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 200, 5000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for r in df.select("x", pii.running(F.col("x"), lambda a, b: a + b).alias("s"), pii.running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).collect():
        assert r.s == [sum(r.x[:k]) for k in range(len(r.x))] and r.m == [max([0, *r.x[:k]]) for k in range(len(r.x))]


def test_long_texts_with_many_matches(spark):
    text = "é call +1 234 555 0199 or x@y.zz; 10.0.0.1 " * 20_000
    df = spark.createDataFrame([(1, text, None)], "doc_id long, text string, n_chars int")
    start = time.perf_counter()
    found = pii.base_spans(df).select(F.size("base"), F.array_max(F.transform("base", lambda x: x["to"]))).first()
    assert tuple(found) == (60_000, len(text) - 1)
    want = "é call <PHONE> or <EMAIL>; <IP> " * 20_000
    out = pii.stage(spark, df, "").select("n_chars", F.sha2("text", 256)).first()
    assert tuple(out) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    assert time.perf_counter() - start < 120


def test_redaction_of_overlapping_spans_at_block_edges(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = "".join(rng.choice("abé日😀") for _ in range(rng.randrange(1, 60)))
        spans = sorted({(a, "card", min(len(text), a + rng.randrange(1, 9))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(1, 7)))})
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, "k int, text string, spans array<struct<at:int,kind:string,to:int>>")
    for block in (7, 4096):
        monkeypatch.setattr(pii, "_BLOCK", block)
        for r in df.select("k", "text", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("out")).collect():
            want, end = "", 0
            for s in r.spans:
                if s.at >= end:
                    want += r.text[end : s.at] + "<CARD>"
                end = max(end, s.to)
            assert r.out == want + r.text[end:]


def test_stage_keeps_any_columns(spark):
    rows = [("k", 1, "to x@y.zz", 9, "a", 3), ("l", 1, "to x@y.zz", 9, "a", 4), (None, None, None, None, None, None), ("m", 2, "", 0, "b", 5)]
    df = spark.createDataFrame(rows, "k1 string, doc_id int, text string, n_chars int, `row` string, `spans` int").withColumnRenamed("k1", "k2")
    out = pii.stage(spark, df, "")
    want = [("k", 1, "to <EMAIL>", 10, "a", 3), ("l", 1, "to <EMAIL>", 10, "a", 4), *rows[2:]]
    assert out.dtypes == df.dtypes and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_digest_and_redaction(spark):
    text = "a x@y.zz, card 4111 1111 1111 1111 é +1 234 555 0199!"
    df = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "clean", "en", "s", 5), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in pii.stage(spark, df, "").collect()}
    assert out[1].text == "a <EMAIL>, card <CARD> é <PHONE>!" and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[2].n_chars, out[3].text) == ("clean", 5, None)
    found = pii.find_pii(df).filter("doc_id = 1").select(F.sha2(pii._listed("base"), 256)).first()[0]
    assert found == hashlib.sha256(brute(text).encode()).hexdigest()
