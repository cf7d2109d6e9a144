"""Secret scans, token counts, packing, token files: against the library and brute force."""

import base64
import bz2
import collections
import gzip
import hashlib
import math
import random
import re
import textwrap
import time
import urllib.parse
import zlib

import numpy as np
import pytest

from pairloom.llm.op1_secret_scans import Scanner, redact, secret_scans, written
from pairloom.llm.op2_token_counts import PrefixCounter, fit_budgets, prefix_table, token_counts
from pairloom.llm.op3_packing import pack, packed
from pairloom.llm.op9_token_files import Shard, pack_shard, read_shards, staged, token_files, write_shards
from pairloom.llm.tokens import Encoder

SECRET = "password = hunter2hunter2"


def layers(text):
    return {s[0] for s in Scanner().scan(text)[1]}


def test_nested_layers_are_found_and_mapped():
    b64 = base64.b64encode(SECRET.encode()).decode()
    cases = {
        "url": urllib.parse.quote(SECRET, safe=""),
        "twice": urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "reference": "".join(f"&#{ord(c)};" for c in SECRET),
        "base64": b64,
        "base64 of base64": base64.b64encode(b64.encode()).decode(),
        "packed": base64.b64encode(gzip.compress(SECRET.encode())).decode(),
        "packed twice": base64.b64encode(gzip.compress(gzip.compress(SECRET.encode()))).decode(),
        "url of base64": urllib.parse.quote(b64 + "==", safe=""),
    }
    for name, code in cases.items():
        text = f"some words {code} and more"
        base, spans, n, _ = Scanner().scan(text)
        assert base == [] and n >= 1, name
        found = [s for s in spans if s[0] == "assign"]
        assert found, name
        assert all(10 <= a < b <= 11 + len(code) for _, a, b in found), name


def test_exact_places_inside_escapes():
    text = "x pass%77ord=abcdefg y"
    assert Scanner().scan(text)[1] == [("assign", 2, 20)]


def test_clean_text_and_cycles():
    assert layers("nothing to see, " + hashlib.sha256(b"x").hexdigest().upper() + " 100% sure & done") == set()
    loop = base64.b64encode(gzip.compress(b"\x00\x01" * 50)).decode()
    assert layers(loop) == set()


def test_large_packed_layer_is_read_as_a_stream():
    bomb = base64.b64encode(gzip.compress(b"z" * 3_000_000 + SECRET.encode())).decode()
    base, spans, _, streamed = Scanner(max_layer=1 << 20).scan(bomb)
    assert streamed == 1 and [s[0] for s in spans] == ["assign"]


def test_one_rule_for_layers_of_every_size():
    plain = SECRET.encode()
    odd = [b"\x1b[31mred\x1b[0m " + plain, b"nul \0 " + plain, b"stray \xff\xfe\xe9 " + plain, SECRET.encode("utf-16"), ("log " + SECRET).encode("utf-16-be")]
    inner = [urllib.parse.quote(SECRET, safe="").encode(), b"".join(b"\\u%04x" % c for c in plain), base64.b64encode(plain), base64.b64encode(gzip.compress(plain))]
    filler = b"".join(b"line %d\n" % k for k in range(8_000))
    for data in odd + inner:
        for packed in (data, gzip.compress(data), gzip.compress(filler + data + b" \n" + filler), gzip.compress(gzip.compress(filler + data + b" \n"))):
            for most in (1 << 24, 1 << 16):
                _, spans, _, streamed = Scanner(max_layer=most).scan("x " + base64.b64encode(packed).decode())
                assert "assign" in {s[0] for s in spans}, (data, len(packed), most)
    for at in range(65_536 - 60, 65_536, 7):  # an encoded stretch over the end of a window
        bomb = gzip.compress(b". " * (at // 2) + inner[3] + b" " + b". " * 60_000)
        assert [s[0] for s in Scanner(max_layer=1 << 16).scan(base64.b64encode(bomb).decode())[1]] == ["assign"]


def test_wrapped_glued_and_concatenated_payloads():
    noise = "".join(hashlib.sha256(b"%d" % k).hexdigest().upper() + "\n" for k in range(60))
    late = (noise + SECRET).encode()
    wrap = lambda data, n, end: end.join(textwrap.wrap(base64.b64encode(data).decode(), n))
    for n in range(4):
        plain = b"." * (40 + n) + SECRET.encode()  # the secret goes over the line break
        for data in (plain, gzip.compress(late), zlib.compress(late), bz2.compress(late)):
            for code in (wrap(data, 64, "\n"), wrap(data, 76, "\r\n"), wrap(data, 64, "\n    "), f"-----BEGIN CERTIFICATE-----\n{wrap(data, 64, chr(10))}\n-----END CERTIFICATE-----"):
                text = f"some words\n{code}\nand more words"
                spans = [s for s in Scanner().scan(text)[1] if s[0] == "assign"]
                assert spans and all(11 <= a < b <= 11 + len(code) for _, a, b in spans), (data[:4], code[:80])
        glued = base64.b64encode(gzip.compress(late + b"%d" % n, mtime=n)).decode()
        assert "/" in glued
        for path in ("cb/", "a_b-", "data/x/", "name-0123456789_"):
            for code in (path + glued, path + base64.b64encode(b"\xff\xff\xfe??" + SECRET.encode()).decode() + "/more/path"):
                assert "assign" in layers(f"see {code} there"), code[:60]
    for pack in (gzip.compress, bz2.compress, zlib.compress):
        for data in (pack(b"one") + pack(b"two") + pack(SECRET.encode()), pack(b"one") + gzip.compress(SECRET.encode()), pack(b"." * 200_000) * 2 + pack(SECRET.encode())):
            for most in (1 << 24, 1 << 16):
                assert "assign" in {s[0] for s in Scanner(most).scan(base64.b64encode(data).decode())[1]}
    text = "averylongwordwithoutbreaks\nThe quick brown fox\nanotherverylongwordhere\nword"
    assert layers(text) == set()


@pytest.mark.parametrize("most", [1 << 24, 1 << 16])
def test_long_runs_over_the_windows_of_a_layer(most):
    rng = random.Random(3)
    inner = gzip.compress((SECRET + " " + rng.randbytes(9_000).hex()).encode())
    coded = base64.b64encode(inner).decode()
    lines = textwrap.wrap(coded, 76)
    forms = [
        "".join(f"%{ord(c):02X}" for c in coded),
        "".join(f"\\u{ord(c):04x}" for c in coded[: len(coded) // 4 * 4]),
        "".join(f"&#{ord(c)};" for c in coded),
        "\n".join(lines),
        "\r\n".join("    " + x for x in lines),
        "\n".join("> " + x for x in lines),
        "\n".join("\t" + x for x in lines),
    ]
    for form in forms:
        for at in range(65_536 - len(form), 65_536, len(form) // 5 + 1):
            bomb = gzip.compress(b". " * (at // 2) + b"\n" + form.encode() + b"\n" + b". " * 60_000)
            _, spans, _, streamed = Scanner(most).scan(base64.b64encode(bomb).decode())
            assert "assign" in {s[0] for s in spans}, (form[:20], len(form), at)
            assert (streamed > 0) == (most < 1 << 20)


def test_long_random_run_takes_linear_time():
    took = []
    for size in (300_000, 1_200_000):
        run = base64.b64encode(random.Random(5).randbytes(size)).decode()
        start = time.process_time()
        assert Scanner().scan(run + " " + SECRET)[0]
        assert Scanner().scan("\n".join(textwrap.wrap(run, 76)))[3] == 0
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0], took


def test_words_without_a_break(library):
    rng = random.Random(1)
    counter = PrefixCounter()
    for letters, size in (("abcdefghij", 200_000), ("a", 100_000), (" ", 20_000), ("äöüßabcd日本", 40_000)):
        text = "x " + "".join(rng.choice(letters) for _ in range(size)) + "y"
        start = time.process_time()
        counts = counter.group([text])[0]
        assert time.process_time() - start < 20
        assert len(counts) == len(text) and counts[-1] == len(library.encode(text, add_special_tokens=False).ids)
        for n in (1, 3, 100, 128, 129, 130, 131, 500, 5_000):
            assert counts[n - 1] == len(library.encode(text[:n], add_special_tokens=False).ids), n


def brute(text):
    assign = [m.span() for m in re.finditer(r"(?a)((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    access = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    spans = sorted([("assign", *s) for s in assign] + [("access", *s) for s in access] + [("hex", *s) for s in hexes], key=lambda s: (s[1], rank[s[0]]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans), len(assign), len(access), len(hexes)


def test_scans_of_tables(odd, empty, small):
    assert secret_scans(empty).count() == 0
    for docs in (odd, small):
        texts = collections.Counter()
        for d in docs.collect():
            spans, *n = brute(d.text or "")
            texts[(d.doc_id, hashlib.sha256(spans.encode()).hexdigest(), *n)] += 1
        got = secret_scans(docs).collect()
        assert collections.Counter((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == texts


def test_redaction_keeps_rows_and_clean_texts(odd, empty):
    assert redact(empty).count() == 0 and redact(odd).columns == odd.columns
    before = collections.Counter(d.text for d in odd.collect())
    after = collections.Counter(d.text for d in redact(odd).collect())
    assert sum((before - after).values()) == 1
    (new,) = after - before
    assert new == "[access] token = abc [assign]' [hex]"
    assert written([("hex", 3, 5), ("assign", 3, 4)]) == "assign:3:4,hex:3:5"


def test_every_prefix_equals_the_library(library, small):
    counter = PrefixCounter()
    rng = random.Random(5)
    texts = ["'ll 're 've!!'s \n's", "  \n\t x　y 12345 ééé 日本語 🙂 we're 'r", "<|endoftext|>", "a <|endoftext|>b", "  a   b", "", " "]
    texts += ["".join(rng.choice(" \n'relvs.é日a1") for _ in range(60)) for _ in range(30)]
    texts += [r.text[:200] for r in small.limit(10).collect()]
    for t in texts:
        want = [len(library.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))]
        assert counter.prefixes(t).tolist() == want, t
        assert counter.group([t])[0].tolist() == want, t


def test_counts_and_stored_prefixes(odd, empty, small, ids_of):
    assert token_counts(empty).count() == 0 and prefix_table(empty).count() == 0
    for docs in (odd, small):
        want = collections.Counter((d.doc_id, len((d.text or "").encode()), len(ids_of(d.text, []))) for d in docs.collect())
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs).collect()) == want
    table = staged(prefix_table(small))
    direct = {r.doc_id: r.fit_chars for r in token_counts(small, budget=100).collect()}
    assert {r.doc_id: r.chars for r in fit_budgets(table, [100]).collect()} == direct


def test_encoder_equals_the_library(ids_of):
    rng = random.Random(2)
    texts = ["".join(rng.choice([" ", "  ", "\n", " \n", "ab", "c'll", "é", "　", "<|endoftext|>"]) for _ in range(40)) for _ in range(200)]
    assert Encoder().encode(texts) == [ids_of(t, []).tobytes() for t in texts]


def test_new_words_are_encoded_in_bounded_lines(ids_of, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé\n\t.,'-1", k=rng.randint(1, 12))) + "x" for _ in range(20_000)]
    texts = [" ".join(words[k : k + 400]) for k in range(0, len(words), 400)]
    encoder, calls = Encoder(), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda batch: calls.append(len(batch)) or ids(batch))
    assert encoder.encode(texts) == [ids_of(t, []).tobytes() for t in texts]
    assert max(calls) <= 64 and sum(calls) < len(words) / 20


def test_plan_never_overfills_and_places_every_piece():
    rng = random.Random(1)
    for _ in range(10):
        h = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        plan = pack(h, 64, 20)
        fill = collections.Counter()
        for size, slots in plan.slots.items():
            assert sum(hi - lo for lo, hi, *_ in slots) == h[size]
            for lo, hi, n, first, _ in slots:
                for r in range(hi - lo):
                    fill[first + r // n] += size
        assert max(fill.values()) <= 64 and len(fill) == plan.bins
        assert plan.bins <= 1.25 * math.ceil(sum(s * n for s, n in h.items()) / 64) + 2
    assert pack({}).bins == 0


def test_packing(odd, empty, small, ids_of, crc):
    assert packed(empty).count() == 0
    for docs in (odd, small):
        rows = packed(docs).collect()
        want = collections.Counter()
        total = 0
        for d in docs.collect():
            ids = ids_of(d.text, [2])
            total += len(ids)
            cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[(d.doc_id, k, a, b - a, crc(ids[a:b]))] += 1
        assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for places in by.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 1024
        assert len(by) <= 1.02 * math.ceil(total / 1024) + 4


def test_token_files(odd, empty, small, ids_of, crc):
    assert token_files(empty).count() == 0
    rows = {r.doc_id: r for r in token_files(small, shard_tokens=20_000).collect()}
    at = 0
    for d in small.orderBy("doc_id").collect():
        ids = ids_of(d.text, [0])
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    got = sorted((r.start, r.n_tokens) for r in token_files(odd).collect())
    assert len(got) == odd.count() and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    nulls = [r for r in read_shards(staged(write_shards(odd))).collect() if r.doc_id is None]
    assert len(nulls) == 2 and min(r.start for r in nulls) == 0


def test_wavelet_access_rank_select(ids_of, small):
    rng = random.Random(4)
    for x in ([], [7], [5] * 700, [70_000_000, 3, 3], ids_of(small.first().text, []).tolist()):
        shard = Shard(pack_shard(np.array(x, dtype="<u4"), [len(x)], [1]))
        assert shard.ids().tolist() == x
        for _ in range(60 if x else 0):
            i, t = rng.randrange(len(x)), rng.choice(x)
            assert shard.access(i) == x[i] and shard.rank(t, i) == x[:i].count(t)
            places = [j for j, y in enumerate(x) if y == t]
            k = rng.randrange(len(places))
            assert shard.select(t, k) == places[k] and shard.select(t, len(places)) is None
        assert shard.rank(999_999, len(x)) == 0 and shard.select(999_999, 0) is None
