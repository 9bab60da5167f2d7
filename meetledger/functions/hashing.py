"""Payload hashes, deterministic keys and the chat user-id codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a JSON string literal, or a run of blanks between tokens
_LITERAL_OR_BLANK = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+'


def compact_json(json_text: Column) -> Column:
    """The same JSON text without blanks between tokens; key order is kept."""
    return F.regexp_replace(json_text, _LITERAL_OR_BLANK, "$1")


def canonical_json(json_text: Column) -> Column:
    """JSON with sorted keys and no blanks; the input text when it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text)


# a string literal, a number, or a run of other characters between blanks
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?\d[\d.eE+-]*+|[^\s"\d-]++'
# inside a literal: a coded unit, an escape, a plain run, or one other character
_PIECE = r"(?s)\\u[0-9a-fA-F]{4}|\\.|[ -.0-\[\]-\x7F]++|."
# fixed values: characters that are written with an escape of their own
_ESCAPES = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r", 34: r"\"", 47: r"\/", 92: r"\\"}


def _coded(char: Column) -> Column:
    """A character as its UTF-16 units in hexadecimal."""
    return F.regexp_replace(F.lower(F.hex(F.encode(char, "UTF-16BE"))), "(.{4})", r"\\u$1")


def _live_piece(piece: Column) -> Column:
    unit = F.conv(F.substring(piece, 3, 4), 16, 10).cast("int")
    table = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])
    decoded = F.when(unit >= 128, F.lower(piece)).otherwise(
        F.coalesce(F.try_element_at(table, unit), F.when(unit < 32, F.lower(piece)), F.char(unit))
    )
    return (
        F.when(piece.rlike(r"\A\\u[0-9a-fA-F]{4}\z"), decoded)
        .when(piece == "/", F.lit(r"\/"))
        .when(piece.rlike(r"\A[\x20-\x7F]"), piece)
        .otherwise(F.coalesce(F.try_element_at(table, F.ascii(piece)), _coded(piece)))
    )


def _live_number(number: Column) -> Column:
    value = number.try_cast("double")
    shown = value.cast("string")
    exponent = F.regexp_extract(shown, r"E(-?\d+)\z", 1)
    plain = F.regexp_replace(shown.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+\z", "$1")
    power = F.concat(
        F.regexp_replace(shown, r"(\.0)?E.*\z", ""), F.lit("e"), F.when(exponent.startswith("-"), "").otherwise("+"), exponent
    )
    real = F.when(exponent == "", shown).when(exponent.cast("int").between(-4, 15), plain).otherwise(power)
    return F.when(~number.rlike("[.eE]"), F.when(number == "-0", "0").otherwise(number)).otherwise(
        F.when(F.abs(value) < float("inf"), real).otherwise(number)
    )


def live_json(json_text: Column) -> Column:
    """The JSON text as the live service writes it again after reading: keys in their order, no blanks.

    Characters beyond ASCII become ``\\u`` units in small letters, ``/`` becomes ``\\/``, coded
    ASCII becomes plain, and reals take their shortest form (``1.50`` is ``1.5``, ``15e-1``
    too; powers from 16 and below -4). Whole numbers stay as they are. NULL stays NULL, a
    text that is no JSON only loses its blanks. A key that an object repeats stays twice.
    """
    token = lambda t: (
        F.when(t.rlike(r'\A"[ -.0-\[\]-\x7F]*+"\z'), t)
        .when(t.startswith('"'), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECE), 0), _live_piece), ""))
        .when(t.rlike(r"\A-?\d"), _live_number(t))
        .otherwise(t)
    )
    return F.array_join(F.transform(F.regexp_extract_all(json_text, F.lit(_TOKEN), 0), token), "")


def payload_hash(json_text: Column, mode: str = "text") -> Column:
    """md5 of the payload: of its text, or of its live, compact or canonical form."""
    forms = {"text": lambda c: c, "live": live_json, "compact": compact_json, "canonical": canonical_json}
    return F.md5(forms[mode](json_text))


def idempotency_key(event_type: Column, booking_id: Column, json_text: Column) -> Column:
    """sha256 over type, booking and canonical payload."""
    return F.sha2(F.concat_ws(":", event_type, booking_id, canonical_json(json_text)), 256)


def _aes_key(secret: str) -> Column:
    return F.unhex(F.sha2(F.lit(secret), 256))


_ZERO_IV = "00000000000000000000000000000000"


def encode_user_id(user_id: Column, secret: str) -> Column:
    """AES-256-CBC with a zero IV, then url-safe base64 without padding."""
    sealed = F.aes_encrypt(user_id, _aes_key(secret), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit(_ZERO_IV)))
    body = F.substring(sealed, F.lit(17), F.octet_length(sealed) - F.lit(16))
    return F.rtrim(F.translate(F.regexp_replace(F.base64(body), r"\s", ""), "+/=", "-_ "))


def open_user_id(encoded: Column, secret: str) -> Column:
    """Reverse of :func:`encode_user_id`; NULL for what cannot be opened."""
    padded = F.rpad(
        F.translate(encoded, "-_", "+/"),
        (F.ceil(F.length(encoded) / 4) * 4).cast("int"),
        "=",
    )
    # the decrypt function expects the IV in front of the data
    sealed = F.concat(F.unhex(F.lit(_ZERO_IV)), F.try_to_binary(padded, F.lit("base64")))
    opened = F.try_aes_decrypt(sealed, _aes_key(secret), F.lit("CBC"), F.lit("PKCS"))
    return F.try_validate_utf8(opened.cast("string"))


def decode_user_id(encoded: Column, secret: str | None) -> Column:
    """Reverse of :func:`encode_user_id`; input unchanged without a secret or on any failure."""
    return F.coalesce(open_user_id(encoded, secret), encoded) if secret else encoded
