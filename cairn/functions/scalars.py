"""Scalar functions of the ledger as Spark columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a chunk, and digits of base 32.
CHUNK = 262_144
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def redenominated(amount: Column, base: Column, target: int) -> Column:
    """``amount`` in a later denomination: a thousandfold for each step; base 0 leaves it."""
    steps = F.when(base == 0, 0).otherwise(target - base)
    return amount.cast("decimal(38,0)") * F.when(steps == 0, 1).when(steps == 1, 1000).when(steps == 2, 1_000_000).otherwise(F.raise_error(F.lit("no such denomination"))).cast("decimal(10,0)")


def base64url(binary: Column) -> Column:
    """Unpadded base 64 in the alphabet for URLs."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(binary), "[\r\n]", ""), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    pad = F.repeat(F.lit("="), (4 - F.length(text) % 4) % 4)
    return F.unbase64(F.concat(F.translate(text, "-_", "+/"), pad))


def base32_of_hex(digits: Column, length: int) -> Column:
    """Unpadded lower-case base 32 of ``length`` hexadecimal digits, a multiple of ten."""
    parts = [F.lower(F.lpad(F.conv(F.substring(digits, at, 10), 16, 32), 8, "0")) for at in range(1, length + 1, 10)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", BASE32)


def ceil_to(n: Column, step: int) -> Column:
    """The next multiple above, even of a multiple itself."""
    return (F.floor(n / step) + 1) * step


def padded(n: Column, step: int = CHUNK) -> Column:
    """The multiple at or above; 0 stays."""
    return F.ceil(n / step) * step


def clamp(n: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(n, F.lit(most)))


def pieces(text: Column, size: int) -> Column:
    """``text`` cut into pieces of ``size`` characters; none for an empty one."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packing_kind(packing: Column) -> Column:
    """The kind of a packing written as ``kind``, ``kind_address`` or ``kind_address.difficulty``."""
    return F.regexp_extract(packing, r"^(unpacked|spora_2_6|composite|replica_2_9)", 1)


def packing_address(packing: Column) -> Column:
    return F.nullif(F.regexp_extract(packing, r"^(?:spora_2_6|composite|replica_2_9)_([^.]*)", 1), F.lit(""))


def packing_difficulty(packing: Column) -> Column:
    """The difficulty behind the dot, 0 without one."""
    return F.coalesce(F.when(packing.contains("."), F.split_part(packing, F.lit("."), F.lit(-1)).cast("int")), F.lit(0))


def digest(data: Column, bits: int) -> Column:
    return F.unhex(F.sha2(data, bits))


def deep_hash(parts: Column | list, bits: int = 384) -> Column:
    """The tagged hash of a text or binary, or of a list of such and lists: a list's hash takes in its elements' one by one."""
    if not isinstance(parts, list):
        data = parts.cast("binary")
        tag = F.concat(F.lit("blob"), F.octet_length(data).cast("string"))
        return digest(F.concat(digest(tag.cast("binary"), bits), digest(data, bits)), bits)
    out = digest(F.lit(f"list{len(parts)}").cast("binary"), bits)
    for part in parts:
        out = digest(F.concat(out, deep_hash(part, bits)), bits)
    return out


def checksum(binary: Column) -> Column:
    """The four bytes of a CRC-32."""
    return F.unhex(F.lpad(F.hex(F.crc32(binary)), 8, "0"))


def with_checksum(binary: Column) -> Column:
    return F.concat(base64url(binary), F.lit(":"), base64url(checksum(binary)))


def decoded_address(text: Column) -> Column:
    """The address of a text, with a checksum of six characters behind a colon or without; null if that is wrong or the length isn't 20 to 64."""
    cut = F.regexp_extract(text, r"^(.*):(.{6})$", 1)
    checked = text.rlike(r"^.*:.{6}$")
    plain = from_base64url(F.when(checked, cut).otherwise(text))
    sound = F.octet_length(plain).between(20, 64) & (base64url(checksum(plain)) == F.regexp_extract(text, r":(.{6})$", 1))
    return F.when(~checked | sound, plain)


def is_infinite(text: Column) -> Column:
    return text == "infinity"


def number(text: Column) -> Column:
    """A whole number, null for ``infinity`` and anything else."""
    return F.when(text.rlike("^-?[0-9]+$"), text).try_cast("long")


def length_prefixed(text: Column) -> Column:
    """A text behind its length in two digits."""
    return F.concat(F.lpad(F.octet_length(text).cast("string"), 2, "0"), text)


def status_class(code: Column) -> Column:
    hundreds = F.floor(code / 100)
    return F.when(hundreds == 2, "success").when(hundreds == 3, "redirection").when(hundreds == 4, "client-error").when(hundreds == 5, "server-error").otherwise("unknown")


def seconds_of(mega: Column, seconds: Column) -> Column:
    """Seconds of a time given in millions of seconds and the rest."""
    return mega * 1_000_000 + seconds


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def as_mib(size: Column) -> Column:
    return F.concat(F.floor(size / 1_048_576).cast("string"), F.lit(" MiB"))


def signature_kind(code: Column) -> Column:
    return F.when(code == 0, "rsa").when(code == 1, "ecdsa").otherwise("eddsa")


def ciphered(df: DataFrame, key: str, data: str) -> DataFrame:
    """``key`` and ``data`` with the bytes of each row XORed with bytes drawn from its key; doing it twice gives them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mask = (hashlib.sha256(str(k).encode()).digest() * (len(d or b"") // 32 + 1))[: len(d or b"")]
                out.append(None if d is None else np.bitwise_xor(np.frombuffer(d, np.uint8), np.frombuffer(mask, np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [key, data])

    return df.select(key, data).mapInArrow(run, f"{key} long, {data} binary")
