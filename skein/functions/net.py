"""Addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IPv4 networks that count as private.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24",
           "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32")


def ip_number(ip: Column) -> Column:
    """The address as a number; null for anything but four parts of at most 255 without leading zeros."""
    fits = ip.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$")
    part = lambda i: F.get(F.split(ip, r"\."), i).cast("long")
    return F.when(fits, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def _range(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    a, b, c, d = map(int, base.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return low, low + (1 << (32 - int(bits))) - 1


def is_private(ip: Column) -> Column:
    n = ip_number(ip)
    held = F.lit(False)
    for cidr in PRIVATE:
        held = held | n.between(*_range(cidr))
    return F.coalesce(held, F.lit(False))


def is_group(ip: Column) -> Column:
    """Multicast or limited broadcast."""
    n = ip_number(ip)
    return F.coalesce(n.between(*_range("224.0.0.0/4")) | (n == 0xFFFFFFFF), F.lit(False))


def is_host(ip: Column) -> Column:
    return is_private(ip) & ~is_group(ip)


def segment(ip: Column) -> Column:
    """The /24 of an IPv4 address, else the empty string."""
    return F.when(ip_number(ip).isNotNull(), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(F.lit(""))


def is_structural(ip: Column) -> Column:
    return F.substring_index(ip, ".", -1).isin("0", "255")


def is_local_mac(mac: Column) -> Column:
    """Locally administered and not multicast."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")
    return F.coalesce(first.bitwiseAND(F.lit(3)) == 2, F.lit(False))


def seconds_of_day(text: Column) -> Column:
    parts = F.split(text, ":")
    p = lambda i: F.get(parts, i).try_cast("int")
    return F.coalesce(F.when(F.size(parts) == 3, p(0) * 3600 + p(1) * 60 + p(2)), F.lit(-1))


# Makers of hardware by the first three bytes of an address, and roles by host name, in order.
MAKERS = {
    "F4:B1:C2": "Dahua", "40:7A:A4": "Dahua", "3C:EF:8C": "Dahua", "E0:50:8B": "Dahua", "D0:39:57": "Dahua", "94:B6:09": "Dahua", "84:15:D3": "Dahua",
    "A8:6D:AA": "Intel", "C4:AA:C4": "TP-Link", "FC:5F:49": "Xiaomi", "60:E9:AA": "Espressif", "D4:AB:61": "Dell", "D4:43:0E": "Cisco", "A8:16:9D": "Samsung", "0A:05:96": "Apple",
}
ROLES = {
    "intercom": r"^(vto|vth)",
    "camera": r"^(es-|ipc|nvr|dvr|dh-)",
    "mobile": r"(iphone|ipad|galaxy|xiaomi|vivo|redmi|honor|huawei|noh-|oppo|android)",
    "workstation": r"(desktop-|laptop-|-pc$|^win|^mh$|^hub)",
    "server": r"(server|nas|srv|r230)",
}
CAMERA_PORTS = ("554", "37777", "3702")


def maker(mac: Column) -> Column:
    """The maker of a hardware address, ``unknown`` if it is null or not listed."""
    known = F.create_map(*[F.lit(x) for pair in MAKERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.substring(mac, 1, 8))), F.lit("unknown"))


def role(name: Column, system: Column, ports: Column) -> Column:
    """What a device is: by the first rule its name fits, else by its system, else by its ports (an array of strings)."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in ROLES.items():
        out = out.when(F.coalesce(name.rlike("(?i)" + pattern), F.lit(False)), kind)
    out = out.when(system.isin("Android", "iOS"), "mobile").when(system.isin("Windows", "Linux"), "workstation")
    return out.when(F.coalesce(F.arrays_overlap(ports, F.array(*map(F.lit, CAMERA_PORTS))), F.lit(False)), "camera").otherwise("unknown")


def family(name: Column) -> Column:
    """The part of a host name that a batch of devices shares: without a hexadecimal or numeric ending, 14 characters, lower case."""
    base = F.regexp_replace(F.regexp_replace(F.trim(name), r"[-_\s]?[0-9A-Fa-f]{4,}$", ""), r"[-_\s]?[0-9]+$", "")
    return F.coalesce(F.lower(F.substring(base, 1, 14)), F.lit(""))


def threat_band(denied: Column, ports: Column) -> Column:
    """By the number of denied flows and of distinct ports."""
    return F.when((denied >= 20000) | ((denied > 4000) & (ports > 6)), "high").when(denied >= 2000, "watch").otherwise("ok")


def side(ip: Column) -> Column:
    """internal or external, by the three site networks; empty for no address."""
    inner = ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return F.when(ip.isNull() | (ip == ""), "").when(inner, "internal").otherwise("external")


def sort_key(ip: Column) -> Column:
    """The parts of an address as numbers, to order by; parts that are no numbers are null."""
    return F.transform(F.split(ip, r"\."), lambda p: p.try_cast("int"))
