"""IPv4 columns."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_EXACT = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"


def ip_to_long(ip: Column) -> Column:
    """Address as a number, or null when it is no dotted quad."""
    parts = F.split(ip, r"\.")
    octet = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    value = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    return F.when(ip.rlike(IPV4_EXACT), value)


def cidr_bounds(cidr: str) -> tuple[int, int] | None:
    """First and last address of an IPv4 block, or None when it is malformed."""
    try:
        net = ipaddress.IPv4Network(cidr.strip(), strict=False)
    except ValueError:
        return None
    return int(net.network_address), int(net.broadcast_address)


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether the address lies in the block; a malformed block or address is false."""
    bounds = cidr_bounds(cidr)
    if bounds is None:
        return F.lit(False)
    return F.coalesce(ip_to_long(ip).between(*bounds), F.lit(False))


def cidr_low(cidr: Column) -> Column:
    """First address of a block held in a column."""
    size = _block_size(cidr)
    return F.floor(ip_to_long(F.substring_index(cidr, "/", 1)) / size) * size


def cidr_high(cidr: Column) -> Column:
    return cidr_low(cidr) + _block_size(cidr) - 1


def _block_size(cidr: Column) -> Column:
    bits = F.coalesce(F.get(F.split(cidr, "/"), 1).try_cast("int"), F.lit(32))
    return F.when(bits.between(0, 32), F.pow(F.lit(2.0), 32 - bits).cast("bigint"))


def network_class(ip: Column) -> Column:
    """Private address ranges are the corporate network; all else is unknown."""
    private = in_cidr(ip, "10.0.0.0/8") | in_cidr(ip, "192.168.0.0/16") | in_cidr(ip, "172.16.0.0/12")
    return F.when(private, F.lit("corporate-lan")).otherwise(F.lit("unknown"))
