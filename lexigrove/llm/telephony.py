"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM across blocks, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import col, documents, materialise, slices, string_array, text_column

RATE, OUT_RATE = 8000, 16000
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17  # fixed values: format tags of the WAVE container
BLOCK = 64

# Fixed values of IMA ADPCM: index changes by code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes: sign, three bits of exponent, four of mantissa, all inverted."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes; even bits inverted, a set sign bit is positive."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU, ALAW = mu_law_table(), a_law_table()


# Fixed values of IMA ADPCM: the step sizes by index.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks (rows of bytes), all blocks at a time.

    A block: first sample (little endian, 16 bits), step index (clipped to 0..88), a byte unused, then two 4-bit codes
    a byte, the lower first. A block of n bytes has 1 + 2 * (n - 4) samples.
    """
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)  # a row for each sample: writes are contiguous
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    k = 1
    for byte in codes:
        for code in (byte & 15, byte >> 4):
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0)
            change += np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[code], 0, 88)
            out[k] = value
            k += 1
    return np.ascontiguousarray(out.T)


def encode_adpcm(samples: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Blocks (rows of ``size`` bytes) that hold 16-bit samples, the last block filled with its last sample; all blocks at a time."""
    per = 1 + 2 * (size - 4)
    blocks = -(-len(samples) // per)
    padded = np.concatenate([samples, np.repeat(samples[-1:], blocks * per - len(samples))]).astype(np.int32).reshape(blocks, per) if blocks else np.zeros((0, per), np.int32)
    out = np.zeros((blocks, size), np.uint8)
    value, index = padded[:, 0].copy(), np.zeros(blocks, np.int32)
    out[:, 0], out[:, 1] = value & 255, (value >> 8) & 255
    for k in range(1, per):
        step = STEPS[index]
        off = padded[:, k] - value
        size_off, code = np.abs(off), np.where(off < 0, 8, 0)
        change = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = size_off >= part
            code = code | np.where(take, bit, 0)
            size_off = size_off - np.where(take, part, 0)
            change = change + np.where(take, part, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (code << (0 if k % 2 else 4)).astype(np.uint8)
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation of 16-bit samples to another rate; rounds half to even."""
    n = len(samples)
    if rate == to or not n:
        return samples.astype(np.int16)
    if to == 2 * rate:
        wide = np.empty(2 * n, np.float32)
        wide[::2] = samples
        wide[1:-1:2] = (samples[:-1].astype(np.float32) + samples[1:]) / 2
        wide[-1] = samples[-1]
        return np.rint(wide).astype(np.int16)
    places = np.arange(n * to // rate) * (rate / to)
    return np.rint(np.interp(places, np.arange(n), samples)).astype(np.int16)


def wave(payload: bytes, tag: int = MU_LAW, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAVE file of stored samples: 8-bit for mu-law and A-law, blocks for ADPCM, 16-bit PCM."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(tag, 8)
    if tag == IMA_ADPCM:
        extra = struct.pack("<HH", 2, 1 + 2 * (block - 4))
        speed = rate * block // (1 + 2 * (block - 4))
    else:
        block, extra, speed = bits // 8, b"" if tag == PCM else struct.pack("<H", 0), rate * bits // 8
    head = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(data: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, stored samples) of a mono WAVE file; ValueError if it is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form:
            if at + 8 + size > len(data):
                raise ValueError("data chunk is cut off")
            return form[0], form[2], form[4], memoryview(data)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no format or data chunk")


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(16-bit samples, rate) of a mono WAVE file in PCM, mu-law, A-law or IMA ADPCM."""
    return decode_all(data)[:2]


def decode_all(data: bytes) -> tuple[np.ndarray, int, str | None]:
    """As ``decode``, and which last bytes are too few for a sample or for a block's header; a shorter last block is decoded."""
    tag, rate, block, stored = read_wave(data)
    raw = np.frombuffer(stored, np.uint8)
    lost = lambda n: f"{n} bytes at the end are no sample" if n else None
    if tag == MU_LAW:
        return MU[raw], rate, None
    if tag == A_LAW:
        return ALAW[raw], rate, None
    if tag == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2").astype(np.int16), rate, lost(len(raw) % 2)
    if tag == IMA_ADPCM:
        if block < 4:
            raise ValueError(f"blocks of {block} bytes have no header")
        whole = len(raw) // block * block
        parts, rest = [decode_adpcm(raw[:whole].reshape(-1, block)).reshape(-1)], len(raw) - whole
        if rest >= 4:  # the last block may be shorter
            parts.append(decode_adpcm(raw[whole:].reshape(1, -1)).reshape(-1))
        return np.concatenate(parts), rate, lost(rest if rest < 4 else 0)
    raise ValueError(f"format {tag} is not known")


def decode_audio(rows: DataFrame, id_col: str, media_col: str, to: int = OUT_RATE) -> DataFrame:
    """One row per input row: id, pcm (resampled 16-bit little-endian samples), rate, error (null if all could be decoded; with pcm, what is left out of it)."""
    some = rows.select(col(id_col).alias("id"), col(media_col).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                pcm, error = [], []
                for media in batch.column(1)[at : at + 64]:
                    try:
                        samples, rate, lost = decode_all(media.as_py() or b"")
                        pcm.append(resample(samples, rate, to).astype("<i2").tobytes())
                        error.append(lost)
                    except ValueError as e:
                        pcm.append(None)
                        error.append(str(e))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 64], pa.array(pcm, pa.binary()), pa.array([to] * len(pcm), pa.int32()), pa.array(error, pa.string())], ["id", "pcm", "rate", "error"])

    return some.mapInArrow(run, f"id {dict(some.dtypes)['id']}, pcm binary, rate int, error string").withColumnRenamed("id", id_col)


def payload(text: bytes, unit: int = BLOCK) -> bytes:
    """The bytes with zeros up to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit or (0 if text else unit))


def _level(samples: np.ndarray) -> float:
    wide = samples.astype(np.float64)
    return float(np.sqrt(np.mean(wide * wide))) if len(samples) else 0.0


FIELDS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pcm_bytes", "pcm_sha256", "feature", "pcm"]
KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (of the text), media: a WAVE file whose 8-bit mu-law samples are the text's padded bytes.

    Null texts count as empty: 64 zero bytes. Repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(col(id_col).alias("id"), text_column(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_array(batch.column(1))
            for a, b in slices(texts):
                data = [t.encode() for t in texts[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) for x in data], pa.int64()), pa.array([wave(payload(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def measure(media: DataFrame, id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """``media`` (id, n_bytes, media) as: id, n_bytes, what the stored file holds, and with ``keep`` the resampled samples as ``pcm``.

    Columns: payload_bytes, payload_sha256 and tail_crc32 (of the samples that the file stores), media_bytes, media_sha256,
    pcm_bytes, pcm_sha256 (16-bit samples at 16 kHz), feature: levels (root mean square) and sign changes of the samples
    read as mu-law, as A-law and as ADPCM blocks.
    """
    rows = media.select(col(id_col).alias("id"), "n_bytes", "media")
    names = FIELDS if keep else FIELDS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                files = [x.as_py() for x in batch.column(2)[a : a + 64]]
                stored = [read_wave(f)[3] for f in files]
                whole = np.frombuffer(b"".join(stored), np.uint8)
                adpcm = decode_adpcm(whole.reshape(-1, BLOCK))  # the blocks of several files at a time
                out, at = [], 0
                for file, data in zip(files, stored, strict=True):
                    codes = np.frombuffer(data, np.uint8)
                    mu, law, ad = MU[codes], ALAW[codes], adpcm[at : at + len(codes) // BLOCK].reshape(-1)
                    at += len(codes) // BLOCK
                    pcm = resample(mu, RATE, OUT_RATE).astype("<i2").tobytes()
                    said = ";".join(f"{k}:{_level(x):.3f}:{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}" for k, x in (("mu", mu), ("a", law), ("ima", ad)))
                    row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(file), hashlib.sha256(file).hexdigest(), len(pcm), hashlib.sha256(pcm).hexdigest(), f"wav/{RATE}/{OUT_RATE};{said}")
                    out.append(row + (pcm,) * keep)
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), KINDS, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 64], batch.column(1)[a : a + 64], *columns], ["id", "n_bytes", *names])

    types = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, " + ", ".join(f"{n} {types[k]}" for n, k in zip(names, KINDS, strict=False))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per input row: the text's bytes stored as 8-bit mu-law samples, read back from the stored table and measured.

    The files are written as a table of media (``media_of_texts``) into the shared folder and read again; see ``measure``
    for the columns. Null texts count as empty: 64 zero bytes. Equal texts give equal values; repeated rows repeated
    results. Empty input: empty result.
    """
    return measure(materialise(media_of_texts(docs, id_col, text_col), "audio-media"), id_col, keep)


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir), keep=False)
