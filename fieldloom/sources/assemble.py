"""Class files from a description of their methods, for fixtures and round trips of the reader."""

from __future__ import annotations

import struct

#: Fixed: opcodes of the class-file format.
_OPS = {"getfield": 0xB4, "putfield": 0xB5, "getstatic": 0xB2, "invokevirtual": 0xB6}
_RETURN, _PUBLIC = 0xB1, 1


class _Pool:
    def __init__(self):
        self.items: list[bytes] = []
        self.at: dict[bytes, int] = {}

    def add(self, item: bytes) -> int:
        if item not in self.at:
            self.items.append(item)
            self.at[item] = len(self.items)
        return self.at[item]

    def utf(self, s: str) -> int:
        b = s.encode()
        return self.add(struct.pack(">BH", 1, len(b)) + b)

    def kind(self, name: str) -> int:
        return self.add(struct.pack(">BH", 7, self.utf(name.replace(".", "/"))))

    def member(self, op: str, owner: str, name: str, descriptor: str) -> int:
        nt = self.add(struct.pack(">BHH", 12, self.utf(name), self.utf(descriptor)))
        return self.add(struct.pack(">BHH", 10 if op == "invokevirtual" else 9, self.kind(owner), nt))


def class_file(name: str, methods: list[tuple[str, str, list[tuple[str, str, str, str]]]], annotations: tuple[str, ...] = (), above: str = "java.lang.Object") -> bytes:
    """methods: (name, descriptor, instructions (op, owner, name, descriptor)); one line number for each instruction."""
    pool = _Pool()
    this, parent = pool.kind(name), pool.kind(above)
    body = b""
    for m_name, m_desc, insns in methods:
        code = b"".join(struct.pack(">BH", _OPS[op], pool.member(op, *target)) for op, *target in insns) + bytes([_RETURN])
        lines = b"".join(struct.pack(">HH", 3 * i, i + 1) for i in range(len(insns)))
        table = struct.pack(">HIH", pool.utf("LineNumberTable"), 2 + len(lines), len(insns)) + lines
        inner = struct.pack(">HHI", 8, 8, len(code)) + code + struct.pack(">HH", 0, 1) + table
        body += struct.pack(">HHHH", _PUBLIC, pool.utf(m_name), pool.utf(m_desc), 1) + struct.pack(">HI", pool.utf("Code"), len(inner)) + inner
    said = b"".join(struct.pack(">HH", pool.utf(a), 0) for a in annotations)
    visible = struct.pack(">HIH", pool.utf("RuntimeVisibleAnnotations"), 2 + len(said), len(annotations)) + said
    head = struct.pack(">IHHH", 0xCAFEBABE, 0, 61, len(pool.items) + 1) + b"".join(pool.items)
    return head + struct.pack(">HHHHHH", _PUBLIC, this, parent, 0, 0, len(methods)) + body + struct.pack(">H", 1) + visible
