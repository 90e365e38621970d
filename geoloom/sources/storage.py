"""Files of the archive on the driver: safe extraction, manifests, raw stores, chips, guarded wipes, raster headers."""

from __future__ import annotations

import shutil
import stat
import struct
import tarfile
import zipfile
import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UnsafeArchive(ValueError):
    """An archive that would write outside its folder, holds links, or is too large."""


def contained(folder: Path, name: str) -> Path:
    """The place of a name in a folder; a name that leaves it is refused."""
    root = folder.resolve()
    target = (root / name).resolve()
    if Path(name).is_absolute() or not target.is_relative_to(root):
        raise UnsafeArchive(f"{name} leaves {folder}")
    return target


def extract(archive: Path, folder: Path, most_files: int = 2000, most_bytes: int = 4 << 30) -> list[Path]:
    """Extract a zip or tar file. Names, kinds, number and sizes are judged before anything is written."""
    if zipfile.is_zipfile(archive):
        opened = zipfile.ZipFile(archive)
        members = [(m.filename, m.file_size, not stat.S_ISLNK(m.external_attr >> 16), m) for m in opened.infolist() if not m.is_dir()]
        reader = opened.open
    elif tarfile.is_tarfile(archive):
        opened = tarfile.open(archive)
        members = [(m.name, m.size, m.isfile(), m) for m in opened.getmembers() if not m.isdir()]
        reader = opened.extractfile
    else:
        raise UnsafeArchive("neither zip nor tar")
    with opened:
        if len(members) > most_files or sum(size for _, size, _, _ in members) > most_bytes:
            raise UnsafeArchive("too many files or bytes")
        if bad := [name for name, _, plain, _ in members if not plain]:
            raise UnsafeArchive(f"no plain file: {bad[0]}")
        places = [(contained(folder, name), m) for name, _, _, m in members]
        for target, member in places:
            target.parent.mkdir(parents=True, exist_ok=True)
            with reader(member) as source, open(target, "wb") as out:
                shutil.copyfileobj(source, out)
    return [t for t, _ in places]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def store_raw(source: Path, folder: Path) -> Path:
    """Move an input to the raw store, read-only; what is there already is never replaced."""
    target = contained(folder, source.name)
    if target.exists():
        raise FileExistsError(target)
    folder.mkdir(parents=True, exist_ok=True)
    shutil.move(source, target)
    for f in [target, *target.rglob("*")] if target.is_dir() else [target]:
        if f.is_file():
            f.chmod(0o444)
    return target


def wipe(root: Path, names: list[str], sure: bool = False) -> list[Path]:
    """Empty the named product folders under a root; refuses without `sure`, and for names that leave the root."""
    if not sure:
        raise PermissionError("refusing to wipe without sure=True")
    gone = []
    for folder in [contained(root, n) for n in names]:
        for child in folder.iterdir() if folder.is_dir() else ():
            shutil.rmtree(child) if child.is_dir() and not child.is_symlink() else child.unlink()
            gone.append(child)
    return gone


def png(rows: list[bytes], path: Path) -> None:
    """Rows of RGB bytes as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]) // 3, len(rows), 8, 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + r for r in rows))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b""))


def chip(cells: DataFrame, path: Path, size: int = 128) -> None:
    """A tile's cells (r, c and bytes red, green, blue; one tile, at most size x size) as a PNG file; places without a cell are black."""
    rows = [bytearray(3 * size) for _ in range(size)]
    for x in cells.where(F.col("r").between(0, size - 1) & F.col("c").between(0, size - 1)).select("r", "c", "red", "green", "blue").collect():
        rows[x.r][3 * x.c : 3 * x.c + 3] = bytes((x.red, x.green, x.blue))
    png([bytes(r) for r in rows], path)


# Fixed values of TIFF and GeoTIFF: tags, types' sizes, the key of a projected system.
WIDTH, HEIGHT, BITS, SAMPLES, FORMAT, SCALE, KEYS, PROJECTED, GEOGRAPHIC = 256, 257, 258, 277, 339, 33550, 34735, 3072, 2048
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tiff_header(data: bytes) -> dict | None:
    """width, height, bands, resolution, crs and dtype of a (Big)TIFF file's first image; None if it is none."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        big = struct.unpack_from(order + "H", data, 2)[0] == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
        tags = {}
        for i in range(n):
            e = at + (8 if big else 2) + i * (20 if big else 12)
            tag, kind = struct.unpack_from(order + "HH", data, e)
            (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, e + 4)
            if kind not in CODES or tag not in (WIDTH, HEIGHT, BITS, SAMPLES, FORMAT, SCALE, KEYS):
                continue
            place = e + (12 if big else 8)
            if count * SIZES[kind] > (8 if big else 4):
                (place,) = struct.unpack_from(order + ("Q" if big else "I"), data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, place)
        keys = tags.get(KEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
        code = codes.get(PROJECTED) or codes.get(GEOGRAPHIC)
        kind = {1: "uint", 2: "int", 3: "float"}[tags.get(FORMAT, (1,))[0]]
        return {"width": tags[WIDTH][0], "height": tags[HEIGHT][0], "bands": tags.get(SAMPLES, (1,))[0], "resolution": tags[SCALE][0] if SCALE in tags else None, "crs": f"EPSG:{code}" if code else None, "dtype": f"{kind}{tags[BITS][0]}"}
    except (KeyError, struct.error, IndexError):
        return None


def raster_headers(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder, band (the file's name) and header of every TIFF file under a folder; a file that cannot be read has none."""
    kind = "struct<width:int,height:int,bands:int,resolution:double,crs:string,dtype:string>"

    @F.pandas_udf(kind)
    def header(content):
        import pandas as pd

        names = ["width", "height", "bands", "resolution", "crs", "dtype"]
        return pd.DataFrame([tiff_header(bytes(x)) or dict.fromkeys(names) for x in content], columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_replace(name, r"(?i)\.tif$", "").alias("band"), header("content").alias("h")).select("path", "folder", "band", "h.*")
