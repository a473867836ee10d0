"""What a report says about the machine: processor, caches, and the limits of its control group. Files that aren't
there give None."""

from __future__ import annotations

from pathlib import Path


def _text(path: Path) -> str | None:
    try:
        return path.read_text().strip()
    except OSError:
        return None


def _pairs(text: str | None, between: str) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, sep, v in (line.partition(between) for line in (text or "").splitlines()) if sep]


def machine(root: str = "/") -> dict[str, object]:
    """model, cores, logical, max_mhz, caches (l1d, l1i, l2, l3) and the processors this process may use."""
    top = Path(root)
    facts = _pairs(_text(top / "proc/cpuinfo"), ":")
    first = lambda name: next((v for k, v in facts if k == name), None)
    khz = _text(top / "sys/devices/system/cpu/cpu0/cpufreq/cpuinfo_max_freq")
    cache = top / "sys/devices/system/cpu/cpu0/cache"
    return {
        "model": first("model name"),
        "cores": int(first("cpu cores") or 0) or None,
        "logical": sum(k == "processor" for k, _ in facts) or None,
        "max_mhz": int(khz) / 1000 if khz and khz.isdigit() else None,
        **{name: _text(cache / f"index{i}/size") for i, name in enumerate(("l1d", "l1i", "l2", "l3"))},
        "cpuset": dict(_pairs(_text(top / "proc/self/status"), ":")).get("Cpus_allowed_list"),
    }


def control_group(root: str = "/sys/fs/cgroup") -> dict[str, float | None]:
    """Seconds of CPU (user, system, total, throttled), bytes of memory, and the limit in cores (None: unlimited)."""
    top = Path(root)
    stat = dict(_pairs(_text(top / "cpu.stat"), " "))
    seconds = lambda name: int(stat[name]) / 1e6 if name in stat else None
    memory, quota = _text(top / "memory.current"), (_text(top / "cpu.max") or "max").split()
    period = float(quota[1]) if len(quota) > 1 else 100_000.0
    return {
        "cpu_user_s": seconds("user_usec"),
        "cpu_system_s": seconds("system_usec"),
        "cpu_total_s": seconds("usage_usec"),
        "cpu_throttled_s": seconds("throttled_usec"),
        "memory_bytes": float(memory) if memory else None,
        "cpu_limit_cores": float(quota[0]) / period if quota[0] != "max" and period > 0 else None,
    }
