"""Functions on virtual paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that a path component may not have on Windows: fixed values.
RESERVED = ("CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$")


def valid_path(path: Column) -> Column:
    """Not empty, no backslash, colon or control character, no empty, ``.`` or ``..`` component."""
    return F.coalesce(~path.rlike(r"[\\:\x00-\x1f\x7f-\x9f]") & path.rlike(r"^(?!\.{1,2}(/|\z))[^/]+(/(?!\.{1,2}(/|\z))[^/]+)*\z"), F.lit(False))


def is_valid_path(path: str) -> bool:
    return bool(path) and not any(c in "\\:" or ord(c) < 32 or 127 <= ord(c) < 160 for c in path) and all(p not in ("", ".", "..") for p in path.split("/"))


def valid_hash(digest: Column) -> Column:
    return F.coalesce(digest.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def parent(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text behind the last dot of the whole path; the path itself without a dot."""
    return F.lower(F.substring_index(path, ".", -1))


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def is_below(path: Column, directory: Column) -> Column:
    return F.startswith(path, F.concat(directory, F.lit("/")))


def overlaps(a: Column, b: Column) -> Column:
    """Equal, or one is a directory above the other."""
    return (a == b) | is_below(a, b) | is_below(b, a)


def moved(path: Column, old: Column, new: Column) -> Column:
    """A path at or below ``old`` as it is after old became ``new``."""
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def relative_executable(path: Column) -> Column:
    """Relative, inside its directory: only ordinary components."""
    return valid_path(path) & ~F.startswith(path, F.lit("/"))


def safe_query(path: Column, length: Column, offset: Column, most: int = 16 << 20) -> Column:
    bad = path.rlike(r"[\\:\x00]") | F.startswith(path, F.lit("/")) | path.rlike(r"(^|/)\.\.(/|\z)")
    return F.coalesce(~bad & (length > 0) & (length <= most) & (offset >= 0), F.lit(False))


def valid_windows_path(path: Column) -> Column:
    """Representable there: no reserved stem, no forbidden character, no component that ends in a space
    or dot or has more than 255 UTF-16 units."""
    units = lambda s: F.octet_length(F.encode(s, "UTF-16LE")) / 2
    stem = lambda s: F.translate(F.substring_index(s, ".", 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    device = lambda s: stem(s).isin(*RESERVED) | stem(s).rlike("^(COM|LPT)[1-9¹²³]\\z")
    good = lambda s: (units(s) <= 255) & ~s.rlike(r"[ .]\z") & ~s.rlike(r'[<>"|?*]') & ~device(s)
    return ((path == "") | valid_path(path)) & F.forall(F.filter(F.split(path, "/"), lambda s: s != ""), good)


def like_windows(path: Column) -> Column:
    """What paths are compared by where case does not matter."""
    return F.upper(path)


def may_access(mode: Column, owner: Column, group: Column, uid: int, gid: int, read: bool = False, write: bool = False, execute: bool = False) -> Column:
    """Whether a read-only tree grants the access: writing never; the superuser reads all and executes
    what anyone may execute."""
    if write:
        return F.lit(False)
    bits = F.when(owner == uid, F.shiftright(mode, 6)).when(group == gid, F.shiftright(mode, 3)).otherwise(mode)
    can_read = F.lit(uid == 0) | (bits.bitwiseAND(4) != 0)
    can_run = (mode.bitwiseAND(0o111) != 0) if uid == 0 else (bits.bitwiseAND(1) != 0)
    return (can_read if read else F.lit(True)) & (can_run if execute else F.lit(True))


def valid_text(column: Column, most: int) -> Column:
    """A label: not empty, at most so many bytes, no control characters or slashes of either kind."""
    return F.coalesce((F.octet_length(column).between(1, most)) & ~column.rlike(r"[\p{Cc}/\\]"), F.lit(False))


def valid_key(column: Column) -> Column:
    """A key: 1 to 64 ASCII letters, digits and hyphens."""
    return F.coalesce(column.rlike(r"\A[A-Za-z0-9-]{1,64}\z"), F.lit(False))
