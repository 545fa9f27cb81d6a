import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from ragframe.llm.privacy import Settings, disclosing_terms, entity_contexts, personal_data
from ragframe.llm.quality import quality, quality_sql
from tests.compare import duck_rows, spark_rows

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if valid(k, m[0])]


def test_quality_against_sql(spark, sf):
    from ragframe.llm.queries import op1_quality

    assert spark_rows(op1_quality(spark, sf)) == duck_rows(sf, quality_sql())


def test_quality_edges(spark, odd_docs):
    got = {r.doc_id: r for r in quality(odd_docs).collect()}
    assert len(got) == 7 and all(r.base_failed and not r.kept for r in got.values())
    assert got[0].n_words == 0 and got[0].clean_text == "" and got[4].n_words == 20000 and got[4].n_repeat_words == 20000
    assert quality(odd_docs.filter("doc_id < 0")).count() == 0


def test_lines_fall_and_documents_stay(spark):
    good = "This is a fine sentence of plain words, and another part of it follows here."
    t = f"{good}\nhome | news | sport | about\nWOW!! BUY!! NOW!! CHEAP!!\na# b# c# d#"
    r = quality(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r.clean_text == good and r.kept


def test_quality_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("a", "x", 3, "one two. " * 6, True, 5)], "_t string, c0 string, _w int, text string, kept boolean, _lw int")
    r = quality(df).first()
    assert (r._t, r.c0, r._w, r._lw, r.n_words, r.kept) == ("a", "x", 3, 5, 12, False)


def test_lines_end_as_sentences_do(spark):
    open_line = "these are rather more than twelve plain words without any end to them at all"
    ends = [open_line + x for x in (".", "!”", ".)", "…  ", "?»")]
    t = "\n".join([*ends, open_line, "a short line", "Alle Rechte vorbehalten", "Tous droits réservés 2020"])
    assert quality(spark.createDataFrame([(t,)], "text string")).first().clean_text == "\n".join([*ends, "a short line"])


def test_base_spans_against_python(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.c@d.e", "x_a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4", "+1 (999) 555-1234+33 1 22 33", "4111 1111 1111 1111 é 4111-1111-1111-1111", "1 2 3 " * 9000, "a" * 50000 + "@", "1" * 50000 + "."]
    texts += ["".join(rng.choice("0123456789+-. ()@ab_%é\n") for _ in range(60)) for _ in range(200)]
    texts += [" ".join(rng.choice(["4111 1111 1111 1111", "10.0.0.1", "a.b@c-d.ef", "+49 30 1234567", "é😀"]) for _ in range(8)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data(df).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert (r.spans.split(",") if r.spans else [])[: len(want)] == want
        assert r.n_email == sum(x.startswith("email") for x in want)


TOKEN = r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|[0-9]+(?:[\x20-][0-9]+)*|[^\W\d_]+|[^\w0-9+]+|."


def kind_of(t):
    if t[0].isalpha():
        return "term"
    kind = "phone" if re.match(r"\+[0-9]", t) else "ip" if re.match(r"[0-9]+\.", t) else "card" if t[0].isdigit() else None
    return kind if kind and valid(kind, t) else None


def items(line, begin):
    """(kind, value, start, end) of terms and entities."""
    out, at = [], 0
    for m in [*re.finditer(BASE["email"], line), None]:
        piece = line[at : m.start() if m else len(line)]
        for x in re.finditer(TOKEN, piece):
            if k := kind_of(x[0]):
                out.append((k, re.sub("[^0-9]", "", x[0]) if k in ("card", "phone") else x[0].lower(), begin + at + x.start(), begin + at + x.end()))
        if m:
            out.append(("email", m[0].lower(), begin + m.start(), begin + m.end()))
            at = m.end()
    return out


def sanitised(texts, s):
    """Spans and clean text of each text, by the definition."""
    contexts = []
    for d, t in enumerate(texts):
        begin = 0
        for line in t.split("\n"):
            own = items(line, begin)
            contexts += [(d, own[i : i + s.context]) for i in range(0, len(own), s.context)]
            begin += len(line) + 1
    n = Counter(v for _, c in contexts for v in {x[1] for x in c if x[0] == "term"})
    e = Counter(v for _, c in contexts for v in {x[:2] for x in c if x[0] != "term"})
    both = Counter((a, b) for _, c in contexts for a in {x[:2] for x in c if x[0] != "term"} for b in {x[1] for x in c if x[0] == "term"})
    extra = defaultdict(dict)
    for d, c in contexts:
        for a in {x[:2] for x in c if x[0] != "term"}:
            for _, v, i, j in (x for x in c if x[0] == "term" and len(x[1]) >= s.least_letters):
                if e[a] < len(contexts):
                    share = math.log2(len(contexts) * both[a, v] / (e[a] * n[v])) / math.log2(len(contexts) / e[a])
                    if share >= 1 / s.alpha:
                        extra[d][i, j] = max(share, extra[d].get((i, j), 0))
    out = []
    for d, t in enumerate(texts):
        more = sorted(("removed" if v >= s.remove_share else "generalised", i, j) for (i, j), v in extra[d].items())
        spans = [*base(t), *(f"{k}:{i}:{j}" for k, i, j in more)]
        clean, at = "", 0
        for i, j, k in sorted((int(i), -int(j), k) for k, i, j in (x.split(":") for x in spans)):
            if i >= at:
                clean += t[at:i] + ("" if k == "removed" else ("[WORD]" if t[i] == t[i].lower() else "[NAME]") if k == "generalised" else f"[{k.upper()}]")
            at = max(at, -j)
        out.append((",".join(spans), clean + t[at:]))
    return out


def test_all_spans_and_clean_texts_against_the_definition(spark):
    rng = random.Random(8)
    common = ["the", "of", "letter", "went", "to", "é", "x"]
    entity = lambda i: rng.choice([f"p{i % 9}@mail.org", f"10.0.{i % 7}.1", "4111 1111 1111 1111", f"+49 30 123456{i % 10}", "300.1.1.1", f"Q{i % 5}.r@b.co"])
    word = lambda: rng.choice(["Meier", "Dorfplatz", "ältere", "zim" + rng.choice("abcdefghij") + rng.choice("abcdefghijklmnop"), *common * 4])
    texts = []
    for i in range(150):
        line = lambda: " ".join(entity(i) if rng.random() < 0.06 else word() for _ in range(rng.randint(0, 30)))
        texts.append("\n".join(line() for _ in range(rng.randint(1, 6))))
    texts += ["Meier\tp1@mail.org,Dorfplatz", "plain words\n\n"]
    for s in (Settings(), Settings(context=7, alpha=10.0, remove_share=0.35)):
        want = sanitised(texts, s)
        # columns with the names that the operator itself might use
        df = spark.createDataFrame([(i, t, "z", 5, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, t string, salt int, key string, c0 int")
        got = {r.doc_id: r for r in personal_data(df, s).collect()}
        assert len(got) == len(texts) and (s == Settings() or sum("generalised" in w[0] for w in want) > 5 and sum("removed" in w[0] for w in want) >= 1)
        for i, w in enumerate(want):
            assert (got[i].spans, got[i].clean_text) == w, texts[i]
            assert (got[i].t, got[i].salt, got[i].key, got[i].c0) == ("z", 5, "k", 1)


def test_disclosing_terms(spark):
    name = lambda i: "name" + "abcdefghij"[i % 10] + "klmnop"[i // 10]
    rows = [(i, f"kontakt {name(i)} a{i}@b.cd\nother line words" if i % 2 else "plain words here\nother line words") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    contexts = entity_contexts(df, Settings(), "text")
    terms = {(r.entity, r.term) for r in disclosing_terms(df, contexts, Settings(), "text").collect()}
    assert terms == {(f"email:a{i}@b.cd", name(i)) for i in range(1, 40, 2)}
    got = {r.doc_id: r.clean_text for r in personal_data(df).collect()}
    assert got[1] == "kontakt  [EMAIL]\nother line words" and got[2] == rows[2][1]


def test_long_texts_with_many_spans(spark):
    mails = "\n".join(f"mail a{i}@x{i}.org now" for i in range(2000))
    words = "joe@x.org " + " ".join("abcdefghij"[i % 10] * 2 + "klmnopqrst"[i // 10 % 10] + "uvwxyz"[i // 100 % 6] * (i // 600 + 1) for i in range(40_000))
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame([(0, mails), (1, words)] + [(i, "plain words") for i in range(2, 30)], "doc_id long, text string")).collect()}
    assert got[0].n_email == 2000 and got[0].clean_text.count("[EMAIL]") == 2000 and got[0].clean_text == re.sub("a[0-9]+@x[0-9]+.org", "[EMAIL]", mails)
    assert got[1].n_email == 1 and got[1].clean_text.startswith("[EMAIL] ") and len(got[1].clean_text) > len(words) - 3000


def test_privacy_edges(spark, odd_docs):
    got = {r.doc_id: r for r in personal_data(odd_docs).collect()}
    assert len(got) == 7 and got[0].clean_text == "" and got[3].clean_text == "word" and all(r.spans == "" for r in got.values())
    assert personal_data(odd_docs.filter("doc_id < 0")).count() == 0
