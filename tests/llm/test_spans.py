"""License scan and personal data against plain Python."""

import hashlib
import re

import pytest

from tests.llm import helpers as H
from tributary.llm import license_scan, private_data, queries

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _places(text):
    words, starts, labels = license_scan.template_words(text), [], set()
    for phrase, label in PHRASES.items():
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def _licences(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r for r in license_scan.scan(docs).collect()}


def test_phrases_match_plain_python(spark):
    texts = H.texts(spark)
    rows = queries.op3_license_scan(spark, H.SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _places(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_hand_made_phrases(spark):
    texts = [
        "MIT License mit-license MIT\nLicense", "the cc by cc by cc by", "GNU General Public Public License",
        "é gnu general public license é apache license", "cc", "gnu gnu general public license license apache",
    ]
    found = _licences(spark, texts)
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _places(text)


def test_changed_notice_is_found_on_neighbouring_diagonals(spark):
    notice = next(t for t in license_scan.TEMPLATES if t.label == "isc").text
    words = notice.split()
    changed = words[:12] + ["really"] + words[12:20] + words[21:]
    apart = words[:6] + H.prose(1, 40).split() + words[12:16]
    found = _licences(spark, [H.prose(2, 300) + " " + " ".join(changed), " ".join(apart)])
    assert found[0]["labels"] == "isc" and found[0]["score"] > 0.5 and found[0]["n_base"] == 0
    assert found[1]["labels"] == "" and found[1]["score"] == 0.0


def _covered(text, template):
    """The longest rising run of template places over all stretches of the text, by trying every start."""
    k = license_scan.TEXT_GRAM
    words, own = license_scan.template_words(text), license_scan.template_words(template.text)
    places = {}
    for t in range(len(own) - k + 1):
        places.setdefault(tuple(own[t : t + k]), []).append(t)
    hits = [(p, t) for p in range(len(words) - k + 1) for t in places.get(tuple(words[p : p + k]), [])]
    best = 0
    for start, _ in hits:
        ends = {}
        for p, t in hits:
            if start <= p <= start + 2 * (len(own) - k + 1) + license_scan.SLACK:
                ends[t] = max(ends.get(t, 0), 1 + max((n for u, n in ends.items() if u < t), default=0))
        best = max(best, *ends.values())
    return best / (len(own) - k + 1)


def test_spans_are_verified(spark):
    by_label = {t.label: t for t in license_scan.TEMPLATES}
    isc = by_label["isc"]
    words = isc.text.split()
    k = license_scan.TEXT_GRAM
    grams = [" ".join(words[i : i + k]) for i in range(0, len(words) - k, k)]
    texts = [
        "permission to use copy modify " * 40, " ".join(reversed(grams)), " ".join(grams[1::2] + grams[::2]), isc.text,
        " ".join(words[: len(words) * 2 // 3]), " ".join(words[: len(words) // 4]), " ".join(words[:5] * 9 + words), " ".join(words + words),
        " filler ".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)), isc.text + " " + H.prose(4, 20_000),
    ]
    found = _licences(spark, texts)
    for i, text in enumerate(texts):
        covered = _covered(text, isc) if i < 9 else 1.0
        assert ("isc" in found[i]["labels"].split(",")) == (covered >= license_scan.LEAST_COVERED), (i, covered, found[i])
        if covered >= license_scan.LEAST_COVERED:
            assert found[i]["score"] == pytest.approx(covered)
    assert found[0]["labels"] == "" and found[0]["score"] == 0.0 and found[1]["labels"] == "" and found[3]["score"] == 1.0


def _spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(number):
        total = 0
        for i, c in enumerate(reversed(number)):
            v = int(c) * (1 + i % 2)
            total += v - 9 * (v > 9)
        return total % 10 == 0

    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


TEXTS = [
    "a@b.c_d@e.f x.y@z-z.co.uk. @ a@.b a@b", "é😀 a.b@c.de 日本 +49 (30) 1234567 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500005555555559", "+1 2 +12345678901234567890 +1()()() 9 ++1 555 000 1234.",
    "1.2.3 1.2.3.4.", "4111 1111 1111 1111  4111 1111 1111 1111", "a" * 3000 + "@" + "b.c" * 400, "1-1-1-1 " * 700,
    "DE89 3704 0044 0532 0130 00 and DE88370400440532013000", "tel 030 1234 5678 or 030 1234 5678" + " " * 60 + "030 1234 5678",
    " ".join(f"u{i}@h{i}.org" for i in range(900)),
]


@pytest.mark.parametrize("table", ["corpus", "hand"])
def test_base_spans_match_plain_python(spark, table):
    if table == "corpus":
        docs, texts = H.corpus(spark), H.texts(spark)
    else:
        texts = dict(enumerate(TEXTS))
        docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = private_data.find(docs).select("doc_id", private_data.span_list("base").alias("base")).collect()
    assert {r["doc_id"]: r["base"] for r in rows} == {k: _spans(t) for k, t in texts.items()}


def test_digest_of_the_query(spark):
    texts = H.texts(spark)
    for r in queries.op9_private_data(spark, H.SF_DIR).collect():
        want = _spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["spans"].startswith(want)
        assert r["n_email"] == want.count("email:") and r["n_phone"] == want.count("phone:")


def test_checksums_and_context(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    added = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["added"]] for r in private_data.find(docs).collect()}
    assert added[8] == [("iban", 0)]  # the second one's check digits are wrong
    assert ("national", 4) in added[9] and ("national", len(TEXTS[9]) - 13) not in added[9]


IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?+(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")


def _added(text):
    """Added spans and scores by plain Python."""

    def beside(start, end, before, after, words):
        near = text[max(before, start - private_data.NEARBY) : start] + " " + text[end : min(after, end + private_data.NEARBY)]
        return re.search(rf"\b(?:{words})", near.lower()) is not None

    spans = []
    for kind, pattern, alone, more, words in (("iban", IBAN, 0.8, 0.2, "iban|bank|account"), ("national", NATIONAL, 0.3, 0.4, "phone|tel|call|fax|mobile")):
        hits = list(pattern.finditer(text))
        for i, m in enumerate(hits):
            groups = m[0].split(" ")
            ends = range(len(groups), 0, -1) if kind == "iban" else [len(groups)]
            named = [n for n in ends if groups[0][:2] + str(len("".join(groups[:n]))) in private_data.LENGTHS.split()]
            for n in [*named, *ends]:
                kept = " ".join(groups[:n])
                bare = "".join(groups[:n])
                moved = bare[4:] + bare[:4]
                if kind == "iban" and not (15 <= len(bare) <= 34 and int("".join(str(int(x, 36)) for x in moved)) % 97 == 1):
                    continue
                before = hits[i - 1].end() if i else 0
                after = hits[i + 1].start() if i + 1 < len(hits) else len(text)
                score = alone + (more if beside(m.start(), m.start() + len(kept), before, after, words) else 0)
                if score >= 0.6:
                    spans.append((kind, m.start(), m.start() + len(kept), round(score, 2)))
                break
    return spans


def test_added_spans_match_plain_python(spark):
    number, other = "ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32"
    texts = [
        f"{number} BANK", f"pay {number} BANK CODE NEXT", f"{number}, {other}", f"{other} OK", number.replace(" ", ""), number.replace(" ", "") + " BANK",
        f"IBAN {number[:-1]}3 BANK", f"{number} XX", "tel 0171 234 567 and 0171 234 567", "x" * 60 + " 030 1234 5678 " + "call me", "0171 234 5678", "",
        *H.texts(spark).values(),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"], round(s["score"], 2)) for s in r["added"]] for r in private_data.find(docs).collect()}
    assert found == {i: _added(t or "") for i, t in enumerate(texts)}
    assert found[0] == [("iban", 0, len(number), 1.0)] and found[7] == [("iban", 0, len(number), 0.8)] and found[6] == []


def test_every_span_of_the_query_has_its_score(spark):
    rows = queries.op9_private_data(spark, H.SF_DIR).collect()
    assert all(len(r["spans"].split(",")) == len(r["scores"].split(",")) and bool(r["spans"]) == bool(r["scores"]) for r in rows)
    assert {x for r in rows for x in r["scores"].split(",") if x} <= {"0.70", "0.80", "0.90", "1.00"}


def test_masking(spark):
    docs = spark.createDataFrame([(1, "é write a@b.cd or 1.2.3.4, +49 30 1234567"), (2, "none")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in private_data.masked(docs).collect()} == {1: "é write <email> or <ip>, <phone>", 2: "none"}


def test_native(spark):
    for query in (queries.op3_license_scan, queries.op4_line_dedup, queries.op9_private_data):
        plan = query(spark, H.SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
