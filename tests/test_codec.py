import pytest

from emberlog.functions import codec
from emberlog.sources.log import check_event, read_jsonl


def test_canonical_json():
    assert codec.canonical_json({"b": 1, "a": [1.5, True, None, "é\n\x7f\"\\/"]}) == '{"a":[1.5,true,null,"é\\n\\u007f\\"\\\\/"],"b":1}'
    assert [codec.canonical_json(x) for x in (0.0, -0.0, 100.0, 1e21, 1e22, 1.5e-7, 0.00001, 123456.789, 2**63, -5)] == ["0.0", "-0.0", "100.0", "1e21", "1e22", "1.5e-7", "0.00001", "123456.789", "9223372036854775808", "-5"]


def test_strict_json():
    for bad in ('{"a":1,"a":2}', "[1] x", "NaN", "[" * 129 + "]" * 129, "{"):
        with pytest.raises(codec.CodecError):
            codec.parse_strict(bad)
    assert codec.parse_strict("[" * 128 + "]" * 128)


def test_hex_and_varint():
    assert codec.from_hex("0xabc") == b"\x0a\xbc" and codec.from_hex("") == b""
    for call in (lambda: codec.from_hex("abc", False), lambda: codec.from_lower_hex("AB"), lambda: codec.from_hex("zz"), lambda: codec.decode_varint(b"\x80")):
        with pytest.raises(codec.CodecError):
            call()
    for n in (0, 1, 127, 128, 16383, 16384, 2**40):
        assert codec.decode_varint(codec.encode_varint(n) + b"x") == (n, b"x")
    assert codec.encode_varint(300) == b"\x82\x2c"


def test_npub():
    key = "7e7e9c42a91bfef19fa929e5fda1b72e0ebc1a4c1141673e2794234d86addf4e"
    assert codec.npub(key) == "npub10elfcs4fr0l0r8af98jlmgdh9c8tcxjvz9qkw038js35mp4dma8qzvjptg"
    assert codec.decode_npub(codec.npub(key)) == key
    for bad in ("npub1", codec.npub(key)[:-1] + "q", codec.npub(key).replace("npub", "nsec"), "N" + codec.npub(key)[1:]):
        with pytest.raises(codec.CodecError):
            codec.decode_npub(bad)


def test_schnorr():
    """The first vector of BIP-340, and a changed message."""
    pubkey, sig = codec.sign(3, bytes(32))
    assert pubkey == "f9308a019258c31049344f85f89d5229b531c845836f99b08601f113bce036f9"
    assert sig == "e907831f80848d1069a5371b402410364bdf1c5f8307b0084c55f1ce2dca821525f66a4a85ea8b71e482a74f382d2ce5ebeee8fdb2172f477df4900d310536c0"
    assert codec.verify_signature(pubkey, "00" * 32, sig) and not codec.verify_signature(pubkey, "01" * 32, sig) and not codec.verify_signature("zz", "00", sig)


def test_times_and_hosts():
    assert codec.parse_duration("1.5h") == 5400 and codec.parse_duration("1Y") == 31556952 and codec.parse_range("2d-1d", 200_000) == {"since": 27_200, "until": 113_600}
    for bad in ("", "5", "xh", "5é"):
        with pytest.raises(codec.CodecError):
            codec.parse_duration(bad)
    assert codec.canonical_ip("::ffff:10.0.0.1") == "10.0.0.1" and codec.canonical_ip("x") is None
    assert codec.parse_address(f"30023:{'a' * 64}:x:y") == (30023, "a" * 64, "x:y")


def test_columns(spark):
    rows = spark.createDataFrame([(" wss://Relay.Example/ ", "0" * 16 + "1" + "f" * 47), ("ws://a/b", "f" * 64)], "url string, id string")
    got = rows.select(codec.relay_url(rows.url).alias("u"), codec.leading_zero_bits(rows.id).alias("z")).collect()
    assert [(r.u, r.z) for r in got] == [("relay.example", 67), ("a/b", 0)]


def signed(content, tags=()):
    e = {"pubkey": "", "created_at": 5, "kind": 1, "tags": [list(t) for t in tags], "content": content}
    e["pubkey"] = codec.sign(7, bytes(32))[0]
    e["id"] = codec.event_id(e)
    e["sig"] = codec.sign(7, bytes.fromhex(e["id"]))[1]
    return e


def test_jsonl(spark, tmp_path):
    good = signed("héllo\n", [("t", "x"), ("p", "bad"), ("long", "y")])
    assert codec.verify_signature(good["pubkey"], good["id"], good["sig"])
    text = codec.stored_json(good)
    assert check_event(text) == (text, None) and check_event(text.replace("héllo", "other"))[1] == "bad event id"
    (tmp_path / "in.jsonl").write_text("\n".join([text, "", "{", text.replace('"kind":1', '"kind":70000'), "x" * 50]))
    events, rejected = read_jsonl(spark, str(tmp_path / "in.jsonl"), max_line_bytes=5000)
    assert [(r.content, r.payload, [tuple(t) for t in r.idx_tags]) for r in events.collect()] == [("héllo\n", text, [("t", "x")])]
    assert rejected.count() == 3
    assert read_jsonl(spark, str(tmp_path / "in.jsonl"), max_line_bytes=40)[1].where("reason = 'line too large'").count() == 3
