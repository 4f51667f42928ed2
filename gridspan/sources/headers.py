"""Headers of volume files from their first bytes: what is stored where, and how it lies in space."""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np

#: Element types by their name in a header.
META_TYPES = {"MET_CHAR": "<i1", "MET_UCHAR": "<u1", "MET_SHORT": "<i2", "MET_USHORT": "<u2", "MET_INT": "<i4", "MET_UINT": "<u4", "MET_LONG_LONG": "<i8", "MET_ULONG_LONG": "<u8", "MET_FLOAT": "<f4", "MET_DOUBLE": "<f8"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


NRRD_TYPES = {"char": "i1", "int8": "i1", "int8_t": "i1", "uchar": "u1", "uint8": "u1", "uint8_t": "u1", "short": "i2", "int16": "i2", "int16_t": "i2", "ushort": "u2", "uint16": "u2", "uint16_t": "u2", "int": "i4", "int32": "i4", "int32_t": "i4", "uint": "u4", "uint32": "u4", "uint32_t": "u4", "longlong": "i8", "int64": "i8", "int64_t": "i8", "ulonglong": "u8", "uint64": "u8", "uint64_t": "u8", "float": "f4", "double": "f8"}
#: First bytes that hold a text header.
PROBED = 1 << 16


@dataclass(frozen=True)
class Header:
    """Extents slowest first with channels before them, element type, geometry in x, y, z order; ``offset`` of the first byte."""

    format: str
    shape: tuple[int, ...]
    dtype: str
    origin: tuple[float, ...]
    spacing: tuple[float, ...]
    direction: tuple[float, ...]
    offset: int = 0
    compressed: bool = False
    #: Channels lie side by side in each voxel.
    interleaved: bool = False
    attributes: dict[str, str] = field(default_factory=dict)

    @property
    def region_reads(self) -> bool:
        """Whether a part can be read without the whole."""
        return not self.compressed


def _floats(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split())


def meta_image(data: bytes) -> Header:
    """MetaImage: lines of name = value up to ElementDataFile."""
    fields, at = {}, 0
    while True:
        end = data.index(b"\n", at)
        name, _, value = data[at:end].decode("latin-1").partition("=")
        fields[name.strip()] = value.strip()
        at = end + 1
        if name.strip() == "ElementDataFile":
            break
    size = [int(x) for x in fields["DimSize"].split()]
    n, channels = len(size), int(fields.get("ElementNumberOfChannels", 1))
    dtype = META_TYPES[fields["ElementType"]]
    if fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")).lower() == "true":
        dtype = dtype.replace("<", ">")
    known = {"ObjectType", "NDims", "BinaryData", "BinaryDataByteOrderMSB", "ElementByteOrderMSB", "CompressedData", "CompressedDataSize", "TransformMatrix", "Offset", "Position", "CenterOfRotation", "AnatomicalOrientation", "ElementSpacing", "DimSize", "ElementNumberOfChannels", "ElementType", "ElementDataFile"}
    matrix = _floats(fields["TransformMatrix"]) if "TransformMatrix" in fields else tuple(float(i == j) for i in range(n) for j in range(n))
    # The matrix is stored by columns.
    direction = tuple(matrix[j * n + i] for i in range(n) for j in range(n))
    return Header("mha", (channels, *reversed(size)), dtype, _floats(fields.get("Offset", fields.get("Position", "0 " * n))), _floats(fields.get("ElementSpacing", "1 " * n)), direction, at, fields.get("CompressedData", "False").lower() == "true", channels > 1, {k: v for k, v in fields.items() if k not in known})


def nifti(data: bytes) -> Header:
    """NIfTI-1 in one file; coordinates are turned to left, posterior, superior."""
    packed = data[:2] == b"\x1f\x8b"
    plain = zlib.decompressobj(31).decompress(data, 352) if packed else data
    order = "<" if struct.unpack("<i", plain[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", plain[40:56])
    kind = struct.unpack(order + "h", plain[70:72])[0]
    pixdim = struct.unpack(order + "8f", plain[76:108])
    offset = int(struct.unpack(order + "f", plain[108:112])[0])
    n = max(1, min(3, dims[0]))
    size = [max(1, d) for d in dims[1 : n + 1]]
    sform = struct.unpack(order + "h", plain[254:256])[0]
    spacing = tuple(float(p) or 1.0 for p in pixdim[1 : n + 1])
    if sform > 0:
        rows = np.array(struct.unpack(order + "12f", plain[280:328]), float).reshape(3, 4)
        lps = rows * np.array([[-1], [-1], [1]])
        spacing = tuple(float(s) or 1.0 for s in np.linalg.norm(lps[:n, :n], axis=0))
        direction = tuple((lps[:n, :n] / np.array(spacing)).ravel().tolist())
        origin = tuple(lps[:n, 3].tolist())
    else:
        direction, origin = tuple(float(i == j) for i in range(n) for j in range(n)), (0.0,) * n
    return Header("nii.gz" if packed else "nii", (1, *reversed(size)), order + NIFTI_TYPES[kind], origin, spacing, direction, offset, packed)


def nrrd(data: bytes) -> Header:
    """NRRD with its data behind the header, raw or gzip: lines of field: value up to an empty one, axes fastest first."""
    end = data.index(b"\n\n") if b"\r\n\r\n" not in data[:PROBED] else data.index(b"\r\n\r\n")
    skip = 4 if data[end : end + 2] == b"\r\n" else 2
    fields, attributes = {}, {}
    for line in data[:end].decode("latin-1").splitlines()[1:]:
        if line.startswith("#"):
            continue
        name, mark, value = line.partition(":=" if ":=" in line else ":")
        (attributes if mark == ":=" else fields)[name.strip().lower()] = value.strip()
    if any(k in fields for k in ("data file", "datafile")) or "line skip" in fields or "byte skip" in fields:
        raise ValueError("data beside the header are not read")
    if fields["encoding"] not in ("raw", "gzip", "gz"):
        raise ValueError(f"encoding {fields['encoding']} is not read")
    sizes = [int(x) for x in fields["sizes"].split()]
    kind = NRRD_TYPES[fields["type"].replace("unsigned ", "u").replace("signed ", "")]
    dtype = (">" if fields.get("endian", "little") == "big" else "<") + kind
    vectors = re.findall(r"none|\(([^)]*)\)", fields.get("space directions", ""))
    space = [[float(x) for x in v.split(",")] for v in vectors if v]
    # An axis without a place in space, or more axes than space has, is that of the channels.
    own = len(sizes) - len(space) if space else (1 if fields.get("kinds", "").split()[:1] in (["vector"], ["RGB-color"], ["list"]) else 0)
    if own > 1 or (space and own and vectors[0]):
        raise ValueError("channels are read on the fastest axis only")
    n = len(sizes) - own
    spacing = tuple(float(np.linalg.norm(v)) or 1.0 for v in space) if space else tuple(float(x) if x.lower() != "nan" else 1.0 for x in fields.get("spacings", "1 " * len(sizes)).split()[own:])
    columns = np.array([np.array(v) / s for v, s in zip(space, spacing, strict=True)]).T if space else np.eye(n)
    origin = [float(x) for x in fields["space origin"].strip("()").split(",")] if "space origin" in fields else [0.0] * n
    signs = {"right-anterior-superior": (-1, -1, 1), "ras": (-1, -1, 1), "left-anterior-superior": (1, -1, 1), "las": (1, -1, 1)}.get(fields.get("space", "").lower(), (1, 1, 1))[:n]
    direction = columns * np.array(signs)[:, None]
    return Header("nrrd", (sizes[0] if own else 1, *reversed(sizes[own:])), dtype, tuple(float(o * s) for o, s in zip(origin, signs, strict=True)), spacing, tuple(direction.ravel().tolist()), end + skip, fields["encoding"] != "raw", bool(own), attributes)


def npy(data: bytes) -> Header:
    """NumPy's format, in C order."""
    major = data[6]
    size, start = (struct.unpack("<H", data[8:10])[0], 10) if major == 1 else (struct.unpack("<I", data[8:12])[0], 12)
    text = data[start : start + size].decode("latin-1")
    if "'fortran_order': True" in text:
        raise ValueError("arrays in column order are not read")
    shape = tuple(int(x) for x in re.search(r"'shape': \(([^)]*)\)", text)[1].split(",") if x.strip())
    n = max(1, len(shape) - 1)
    return Header("npy", shape if len(shape) > 1 else (1, *shape), re.search(r"'descr': '([^']*)'", text)[1], (0.0,) * n, (1.0,) * n, tuple(float(i == j) for i in range(n) for j in range(n)), start + size)


def dicom(data: bytes) -> Header:
    """One slice, explicit or implicit little endian, uncompressed; its attributes hold what orders a series and rescales its values."""
    at, explicit, fields = 132, True, {}
    long_form = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR"}
    while at + 8 <= len(data):
        group, element = struct.unpack("<HH", data[at : at + 4])
        vr = data[at + 4 : at + 6]
        if group == 2 or explicit:
            if vr in long_form:
                size, body = struct.unpack("<I", data[at + 8 : at + 12])[0], at + 12
            else:
                size, body = struct.unpack("<H", data[at + 6 : at + 8])[0], at + 8
        else:
            size, body = struct.unpack("<I", data[at + 4 : at + 8])[0], at + 8
        if (group, element) == (0x7FE0, 0x0010):
            fields["pixels"] = body
            break
        if size == 0xFFFFFFFF:
            raise ValueError("sequences of undefined length are not read")
        fields[group, element] = data[body : body + size]
        if (group, element) == (2, 0x10):
            syntax = fields[group, element].rstrip(b"\0 ").decode()
            if syntax not in ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1"):
                raise ValueError(f"transfer syntax {syntax} is not read")
            explicit = syntax.endswith(".2.1")
        at = body + size
    text = lambda tag, other="": fields.get(tag, other.encode()).rstrip(b"\0 ").decode("latin-1")
    number = lambda tag, other: struct.unpack("<H", fields[tag])[0] if tag in fields else other
    rows, columns, bits, signed = number((0x28, 0x10), 0), number((0x28, 0x11), 0), number((0x28, 0x100), 16), number((0x28, 0x103), 0)
    position = [float(x) for x in (text((0x20, 0x32)) or "0\\0\\0").split("\\")]
    turn = [float(x) for x in (text((0x20, 0x37)) or "1\\0\\0\\0\\1\\0").split("\\")]
    between = [float(x) for x in (text((0x28, 0x30)) or "1\\1").split("\\")]
    normal = np.cross(turn[:3], turn[3:])
    direction = np.stack([turn[:3], turn[3:], normal], 1).ravel()
    thick = float(text((0x18, 0x50)) or 1)
    attributes = {"series": text((0x20, 0x0E)), "instance": text((0x20, 0x13), "0"), "slope": text((0x28, 0x1053), "1"), "intercept": text((0x28, 0x1052), "0"), "position": repr(float(np.dot(normal, position)))}
    return Header("dcm", (1, 1, rows, columns), f"<{'i' if signed else 'u'}{bits // 8}", tuple(position), (between[1], between[0], thick), tuple(direction.tolist()), fields.get("pixels", len(data)), attributes=attributes)


def sniff(name: str, data: bytes) -> str | None:
    """The format by content first, by name where the content does not tell; None for no volume."""
    if data[128:132] == b"DICM":
        return "dcm"
    if data[:6] == b"\x93NUMPY":
        return "npy"
    if data[:40].lstrip().startswith((b"ObjectType", b"NDims")):
        return "mha"
    if data[:5] == b"NRRD0":
        return "nrrd"
    if name.endswith((".nii", ".nii.gz")):
        return "nii"
    return None


READERS = {"mha": meta_image, "nii": nifti, "npy": npy, "dcm": dicom, "nrrd": nrrd}


def header_of(name: str, data: bytes) -> Header | None:
    kind = sniff(name, data)
    return READERS[kind](data) if kind else None


def pixels(header: Header, data: bytes) -> np.ndarray:
    """The whole volume, channels first."""
    body = data[header.offset :]
    if header.format == "nii.gz":
        body = gzip.decompress(data)[header.offset :]
    elif header.compressed:
        # With a zlib or a gzip header.
        body = zlib.decompress(body, 47)
    count = int(np.prod(header.shape))
    flat = np.frombuffer(body, np.dtype(header.dtype), count)
    if header.interleaved:
        return np.moveaxis(flat.reshape(*header.shape[1:], header.shape[0]), -1, 0)
    return flat.reshape(header.shape)


def meta_bytes(volume: np.ndarray, header: Header) -> bytes:
    """A MetaImage of a channel-first volume, uncompressed."""
    n = volume.ndim - 1
    names = {np.dtype(v): k for k, v in META_TYPES.items()}
    plain = volume.astype(volume.dtype.newbyteorder("<"))
    turned = [header.direction[j * n + i] for i in range(n) for j in range(n)]
    show = lambda xs: " ".join(repr(float(x)) for x in xs)
    lines = ["ObjectType = Image", f"NDims = {n}", "BinaryData = True", "BinaryDataByteOrderMSB = False", "CompressedData = False", f"TransformMatrix = {show(turned)}", f"Offset = {show(header.origin)}", f"ElementSpacing = {show(header.spacing)}", f"DimSize = {' '.join(map(str, reversed(volume.shape[1:])))}"]
    lines += [f"ElementNumberOfChannels = {volume.shape[0]}"] if volume.shape[0] > 1 else []
    lines += [f"{k} = {v}" for k, v in header.attributes.items()]
    lines += [f"ElementType = {names[plain.dtype]}", "ElementDataFile = LOCAL", ""]
    body = np.ascontiguousarray(np.moveaxis(plain, 0, -1)) if volume.shape[0] > 1 else np.ascontiguousarray(plain)
    return "\n".join(lines).encode("latin-1") + body.tobytes()


#: Element types by their name in Zarr 3.
ZARR_TYPES = {"int8": "<i1", "uint8": "<u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}


def zarr_header(meta: dict, attributes: dict, level: int = 0) -> Header:
    """An OME-Zarr level from its array's metadata and its group's attributes; a channel axis is added where there is none, a time axis dropped."""
    scales = attributes.get("ome", attributes).get("multiscales", [{}])[0]
    axes = [a["name"] for a in scales.get("axes", [])] or ["t", "c", "z", "y", "x"][-len(meta["shape"]) :]
    own = scales.get("datasets", [{}] * (level + 1))[level].get("coordinateTransformations", [])
    scale = next((t["scale"] for t in own if t["type"] == "scale"), [1.0] * len(axes))
    shift = next((t["translation"] for t in own if t["type"] == "translation"), [0.0] * len(axes))
    space = [k for k, a in enumerate(axes) if a in "zyx"]
    channels = meta["shape"][axes.index("c")] if "c" in axes else 1
    n = len(space)
    pick = lambda xs: tuple(float(xs[k]) for k in reversed(space))
    chunks = meta["chunk_grid"]["configuration"]["chunk_shape"]
    return Header("omezarr", (channels, *(meta["shape"][k] for k in space)), ZARR_TYPES[meta["data_type"]], pick(shift), pick(scale), tuple(float(i == j) for i in range(n) for j in range(n)), attributes={"axes": "".join(axes), "chunks": json.dumps(chunks)})


def region_of(header: Header, start: tuple[int, ...], stop: tuple[int, ...]) -> Header:
    """The header of a region: its origin moves by the direction times the voxels before it."""
    n = len(header.origin)
    step = [a * s for a, s in zip(reversed(start), header.spacing, strict=True)]
    origin = tuple(o + sum(header.direction[i * n + k] * step[k] for k in range(n)) for i, o in enumerate(header.origin))
    return replace(header, shape=(header.shape[0], *(b - a for a, b in zip(start, stop, strict=True))), origin=origin)
