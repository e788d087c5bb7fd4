"""Small helpers that run inside tasks: opening a file on any shared file system."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
from urllib.parse import unquote


def open_raw(path: str):
    """A binary stream for a path or URI, through the matching Arrow file system."""
    from pyarrow import fs

    local = re.match(r"^file:/+(.*)$", path)
    if local:
        return open("/" + unquote(local.group(1)), "rb")
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        system, inner = fs.FileSystem.from_uri(path)
        # random access for byte ranges, buffered for line-wise reading
        return io.BufferedReader(system.open_input_file(inner), 1 << 20)
    return open(path, "rb")


def open_plain(path: str):
    """The decompressed bytes of a file, by its suffix."""
    raw = open_raw(path)
    suffix = path.rsplit(".", 1)[-1]
    if suffix == "gz":
        return gzip.GzipFile(fileobj=raw)
    if suffix == "bz2":
        return bz2.BZ2File(raw)
    if suffix == "xz":
        return lzma.LZMAFile(raw)
    if suffix in ("zst", "zstd"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def hash_files(batches):
    import hashlib

    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            digest = hashlib.sha256()
            with open_plain(path) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pdf.assign(sha256=digests)


def xz_lines(batches):
    import pandas as pd

    def frame(row, lines):
        return pd.DataFrame({"source_idx": row.source_idx, "file_idx": row.file_idx, "line": lines})

    for pdf in batches:
        for row in pdf.itertuples():
            with open_plain(row.path) as stream:
                reader = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None)
                lines, size = [], 0
                for line in reader:
                    lines.append(line.rstrip("\n"))
                    size += len(line)
                    if size > 4_000_000:
                        yield frame(row, lines)
                        lines, size = [], 0
                if lines:
                    yield frame(row, lines)
