"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations


def uv(source: str) -> str:
    """Adds u, v to rows with dx, dy, dz."""
    return f"""SELECT *, (a_ + 1) / 2 + CASE WHEN dz < 0 THEN 1.0 ELSE 0.0 END AS u, (b_ + 1) / 2 AS v FROM (
 SELECT *, CASE WHEN phi_ < pi()/4 THEN r_ WHEN phi_ < 3*pi()/4 THEN -(phi_ - pi()/2) * r_ / (pi()/4) WHEN phi_ < 5*pi()/4 THEN -r_ ELSE (phi_ - 1.5*pi()) * r_ / (pi()/4) END AS a_,
  CASE WHEN phi_ < pi()/4 THEN phi_ * r_ / (pi()/4) WHEN phi_ < 3*pi()/4 THEN r_ WHEN phi_ < 5*pi()/4 THEN -(phi_ - pi()) * r_ / (pi()/4) ELSE -r_ END AS b_
 FROM (SELECT *, CASE WHEN raw_ < -pi()/4 THEN raw_ + 2*pi() ELSE raw_ END AS phi_ FROM (SELECT *, sqrt(greatest(1 - abs(dz), 0)) AS r_, atan2(dy, dx) AS raw_ FROM ({source}))))"""


def patch(source: str, side: int) -> str:
    """Adds patch."""
    return f"SELECT *, CASE WHEN dz < 0 THEN {side * side} ELSE CAST(least(floor(u * {side}), {side - 1}) * {side} + least(floor(v * {side}), {side - 1}) AS INT) END AS patch FROM ({uv(source)})"


def position(source: str) -> str:
    """Adds pos to rows with dx..dz and a horizontal view vx, vy, vz (vz = 0) or a vertical one."""
    return f"""SELECT *, least(CASE WHEN top_ < 0 THEN CASE WHEN rr_ > 0.6 THEN 1 + 1.2 * rr_ ELSE 1 + 0.8 * rr_ END
  ELSE exp((35.2 - 0.31889 * tau_ - 1.22 * exp(-2 * tau_ / 9)) / 1000 * sig_ + (21 + 0.26667 * tau_ - 0.002963 * tau_ * tau_) / 100000 * sig_ * sig_) END, 16.0) AS pos FROM (
 SELECT *, degrees(acos(greatest(least(ahead_, 1.0), -1.0))) AS sig_, degrees(atan2(abs(right_), abs(top_))) AS tau_,
  sqrt((right_ * right_ + top_ * top_) / (greatest(ahead_, 1e-6) * greatest(ahead_, 1e-6))) AS rr_ FROM (
 SELECT *, dx*rx_ + dy*ry_ + dz*rz_ AS right_, dx*(ry_*vz - rz_*vy) + dy*(rz_*vx - rx_*vz) + dz*(rx_*vy - ry_*vx) AS top_, dx*vx + dy*vy + dz*vz AS ahead_ FROM (
 SELECT *, CASE WHEN abs(vz) > 0.999 THEN -vz / sqrt(vz*vz + vx*vx) ELSE vy / sqrt(vx*vx + vy*vy) END AS rx_,
  CASE WHEN abs(vz) > 0.999 THEN 0.0 ELSE -vx / sqrt(vx*vx + vy*vy) END AS ry_,
  CASE WHEN abs(vz) > 0.999 THEN vx / sqrt(vz*vz + vx*vx) ELSE 0.0 END AS rz_ FROM ({source}))))"""


def from_uv(source: str, u: str = "u", v: str = "v", out: str = "c") -> str:
    """Adds <out>x, <out>y, <out>z to rows with square coordinates."""
    q = "pi()/4"
    return f"""SELECT * EXCLUDE (fa_, fb_, fr_, fp_), fr_*sqrt(greatest(2 - fr_*fr_, 0))*cos(fp_) AS {out}x, fr_*sqrt(greatest(2 - fr_*fr_, 0))*sin(fp_) AS {out}y, (1 - fr_*fr_)*CASE WHEN {u} > 1 THEN -1 ELSE 1 END AS {out}z FROM (
 SELECT *, CASE WHEN fa_ > -fb_ THEN CASE WHEN fa_ > fb_ THEN {q}*fb_/fa_ ELSE {q}*(2 - fa_/fb_) END ELSE CASE WHEN fa_ < fb_ THEN {q}*(4 + fb_/fa_) ELSE CASE WHEN fb_ <> 0 THEN {q}*(6 - fa_/fb_) ELSE 0 END END END AS fp_ FROM (
 SELECT *, CASE WHEN fa_ > -fb_ THEN CASE WHEN fa_ > fb_ THEN fa_ ELSE fb_ END ELSE CASE WHEN fa_ < fb_ THEN -fa_ ELSE -fb_ END END AS fr_ FROM (
 SELECT *, 2*({u} - CASE WHEN {u} > 1 THEN 1 ELSE 0 END) - 1 AS fa_, 2*{v} - 1 AS fb_ FROM ({source}))))"""


def uniform(seed: int, *keys: str) -> str:
    """The same random number from keys as ``draws.uniform``."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8)) AS BIGINT)/4294967296.0"


VIEWS = "(VALUES (0, 1.0, 0.0, 0.0), (1, -1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, -1.0, 0.0), (4, 0.0, 0.0, 1.0)) views(view, vx, vy, vz)"


def r(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0"
