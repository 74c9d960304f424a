"""HDF5 files of the older layout, made byte by byte for tests."""

import struct
import zlib

import numpy as np

NOWHERE = (1 << 64) - 1


class File:
    def __init__(self):
        self.data = bytearray(96)

    def put(self, body):
        self.data += bytes(-len(self.data) % 8)
        at = len(self.data)
        self.data += body
        return at

    def header(self, messages, split=False):
        """An object header; with split its last messages stand elsewhere."""
        packed = [struct.pack("<HHB3x", kind, len(b) + -len(b) % 8, 0) + b + bytes(-len(b) % 8) for kind, b in messages]
        if not split:
            body = b"".join(packed)
            return self.put(struct.pack("<BBHII4x", 1, 0, len(packed), 1, len(body)) + body)
        late = b"".join(packed[1:])
        at = self.put(late)
        body = packed[0] + struct.pack("<HHB3x", 0x10, 16, 0) + struct.pack("<QQ", at, len(late))
        return self.put(struct.pack("<BBHII4x", 1, 0, len(packed) + 1, 1, len(body)) + body)

    def group(self, members, leaf=4, fan=3):
        """members: name to header address; tables of ``leaf`` names, nodes of ``fan`` children."""
        names, heap = sorted(members, key=lambda n: n.encode()), bytearray(8)
        places = {}
        for n in names:
            places[n] = len(heap)
            heap += n.encode() + b"\0"
            heap += bytes(-len(heap) % 8)
        segment = self.put(bytes(heap))
        heap_at = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), NOWHERE, segment))
        level, nodes = 0, []
        for k in range(0, len(names), leaf):
            some = names[k : k + leaf]
            table = b"SNOD" + struct.pack("<BBH", 1, 0, len(some)) + b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in some)
            nodes.append((self.put(table), places[some[-1]]))
        while True:
            above = []
            for k in range(0, max(1, len(nodes)), fan):
                some = nodes[k : k + fan]
                before = nodes[k - 1][1] if k else 0
                keys = struct.pack("<Q", before) + b"".join(struct.pack("<QQ", at, last) for at, last in some)
                above.append((self.put(b"TREE" + struct.pack("<BBHQQ", 0, level, len(some), NOWHERE, NOWHERE) + keys), some[-1][1] if some else 0))
            nodes, level = above, level + 1
            if len(nodes) == 1:
                return self.header([(0x11, struct.pack("<QQ", nodes[0][0], heap_at))])

    def kind(self, dtype):
        order = 1 if dtype.byteorder == ">" else 0
        if dtype.kind in "iu":
            return struct.pack("<B3BIHH", 0x10, order | (8 if dtype.kind == "i" else 0), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)
        if dtype.kind == "f":
            return struct.pack("<B3BI", 0x11, order | 0x20, 0x1F, 0, dtype.itemsize) + bytes(12)
        return struct.pack("<B3BI", 0x13, 0, 0, 0, dtype.itemsize)

    def dataset(self, values, how="piece", chunk=None, filters=(), split=False, version=1):
        values = np.asarray(values)
        space = struct.pack("<BBB5x", 1, values.ndim, 0) if version == 1 else struct.pack("<BBBB", 2, values.ndim, 0, 1)
        messages = [(0x01, space + struct.pack(f"<{values.ndim}Q", *values.shape)), (0x03, self.kind(values.dtype))]
        raw = values.tobytes()
        if how == "here":
            messages.append((0x08, struct.pack("<BBH", 3, 0, len(raw)) + raw))
        elif how == "piece":
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(raw) if raw else NOWHERE, len(raw))))
        else:
            messages.append((0x08, struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, 2, len(chunk) + 1, self.chunks(values, chunk, filters), *chunk, values.itemsize)))
            each = b"".join(struct.pack("<HHHH", f, 0, 0, 1) + struct.pack("<I4x", 4) for f in filters)
            messages.append((0x0B, struct.pack("<BB6x", 1, len(filters)) + each))
        return self.header(messages, split)

    def chunks(self, values, chunk, filters, fan=3):
        nodes = []
        for place in np.ndindex(*[-(-s // c) for s, c in zip(values.shape, chunk, strict=True)]):
            at = [p * c for p, c in zip(place, chunk, strict=True)]
            part = values[tuple(slice(a, a + c) for a, c in zip(at, chunk, strict=True))]
            full = np.zeros(chunk, values.dtype)
            full[tuple(slice(0, s) for s in part.shape)] = part
            raw, skipped = full.tobytes(), 0
            for j, f in enumerate(filters):
                if f == 1 and not any(place):
                    skipped |= 1 << j  # the first chunk leaves this filter out
                elif f == 1:
                    raw = zlib.compress(raw)
                elif f == 2:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, values.itemsize).T.tobytes()
                else:
                    raw += b"sums"
            nodes.append((struct.pack(f"<II{len(at) + 1}Q", len(raw), skipped, *at, 0), self.put(raw)))
        level, last = 0, struct.pack(f"<II{values.ndim + 1}Q", 0, 0, *values.shape, 0)
        while True:
            above = []
            for k in range(0, len(nodes), fan):
                body = b"".join(key + struct.pack("<Q", at) for key, at in nodes[k : k + fan]) + last
                above.append((nodes[k][0], self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(nodes[k : k + fan]), NOWHERE, NOWHERE) + body)))
            nodes, level = above, level + 1
            if len(nodes) == 1:
                return nodes[0][1]

    def text(self, words):
        """One string of any length, in a heap with others."""
        objects = b""
        for k, w in enumerate(["other", words, "more"], 1):
            b = w.encode()
            objects += struct.pack("<HHIQ", k, 1, 0, len(b)) + b + bytes(-len(b) % 8)
        heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(objects)) + objects)
        cell = self.put(struct.pack("<IQI", len(words.encode()), heap, 2))
        return self.header([(0x01, struct.pack("<BBB5xQ", 1, 1, 0, 1)), (0x03, struct.pack("<B3BI", 0x19, 1, 0, 0, 16) + self.kind(np.dtype("S1"))), (0x08, struct.pack("<BBQQ", 3, 1, cell, 16))])

    def bytes(self, root):
        head = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(self.data), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.data[: len(head)] = head
        return bytes(self.data)
