"""The field on texts that its generator didn't write, and the query's rows against a plain version."""

import hashlib
import re

from glyphmill.llm import pii

#: (text, spans that are personal data). No line comes from pii.examples.
HELD_OUT = [
    ("Reach me at 212-555-0187 before noon.", ["212-555-0187"]), ("Office: (030) 555-2291, ask for Ines", ["(030) 555-2291"]), ("Call 646.555.0143 or write", ["646.555.0143"]),
    ("tel 0044 207 555 1234", ["0044 207 555 1234"]), ("her mobile is 917 555 0166", ["917 555 0166"]), ("write to bob.smith (at) example.org today", ["bob.smith (at) example.org"]),
    ("contact: maria(at)mail.example.com", ["maria(at)mail.example.com"]), ("mail k.lee [at] dept.example.edu", ["k.lee [at] dept.example.edu"]), ("host 10 . 0 . 0 . 17 went down", ["10 . 0 . 0 . 17"]),
    ("ping 192 . 168 . 4 . 250 now", ["192 . 168 . 4 . 250"]), ("card 4111.1111.1111.1111 expires", ["4111.1111.1111.1111"]), ("paid with 5500/0000/0000/0004 yesterday", ["5500/0000/0000/0004"]),
    ("both 212-555-0100 and 646-555-0199 ring", ["212-555-0100", "646-555-0199"]), ("plain a.b@example.com here", ["a.b@example.com"]), ("at +49 30 555 1234 and 8.8.4.4", ["+49 30 555 1234", "8.8.4.4"]),
    ("In 1848 and 2019-03-12 it was 17.5 degrees.", []), ("Order 20231105 costs 1,299.00 euros", []), ("Version 3.11.2 of 4/5/2021", []), ("sha 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", []),
    ("item no 4111111111111112 in stock", []), ("ISBN 978-3-16-148410-1 (1984)", []), ("room 12 on floor 3, 45 seats", []), ("pi is 3.14159 and e 2.71828", []), ("between 10:30 and 11:45", []),
    ("@home and @work since 2002", []), ("lines 120-135 of page 7", []), ("population 3,664,088 in 2020", []), ("section 4.2.1 says 100 percent", []), ("code 300.400.500.600 is no address", []),
]


def test_field_on_texts_of_another_kind():
    field, right, got, want = pii.trained(), 0, 0, 0
    for text, spans in HELD_OUT:
        base = pii.base_spans(text)
        found = {text[a:b] for a, b, _ in base + pii.added(text, base, field)}
        right, got, want = right + len(found & set(spans)), got + len(found), want + len(spans)
    print(f"precision {right / got:.2f}, recall {right / want:.2f}")
    assert right / got >= 0.8 and right / want >= 0.8


def test_long_pieces_and_many_hits_take_linear_time():
    field = pii.trained()
    for text in ("a" * 300_000 + "@" + "b.c" * 1000, "x@" * 30_000, "1" * 100_000, "1.2.3.4, " * 3000, "@" * 50_000):
        base = pii.base_spans(text)
        pii.added(text, base, field)


def test_short_pieces_and_the_word_before_any_blanks():
    field = pii.trained()
    for text, span in (("host 8 . 8 . 4 . 4 is up", "8 . 8 . 4 . 4"), ("ping 1 . 1 . 1 . 1 now", "1 . 1 . 1 . 1")):
        assert [text[a:b] for a, b, _ in pii.added(text, [], field)] == [span]
    text = "my phone" + " " * 40 + "212 555 0187"
    assert pii._before(text, 48) == "phone" and pii._before("x" * 90 + "phone: ", 97) not in pii.CUES[3]
    assert [pii._before(t, len(t)) for t in ("", "  ", "a\n", "a (")] == ["", "", "", "a"]


def plain(text):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_rows(spark):
    texts = [t for t, _ in HELD_OUT] + [None, "", "é a@b.co 1.2.3.4 +12 345 678 90 4111 1111 1111 1111 \U0001f600 x@y.z", "9" * 3000, "1.2.3.4 " * 200]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    got = pii.op8(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_card string").repartition(3)).collect()
    assert len(got) == len(docs)
    texts_of = {}
    for d, t in docs:
        texts_of[d] = t
    for r in got:
        base = plain(texts_of[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for *_, x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        mine = [x for x in r["spans"].split(",") if x]
        assert set(joined.split(",")) - {""} <= set(mine)
    assert pii.op8(spark.createDataFrame([], "doc_id long, text string")).count() == 0
