"""TOML configuration and the packaged templates."""

from __future__ import annotations

import tomllib
from importlib import resources
from pathlib import Path
from typing import Any

TEMPLATES = {
    "build_pointcloud": "build_pointcloud_template.toml",
    "build_signal_points": "build_signal_points_template.toml",
    "colocalization": "colocalization_template.toml",
    "voxelize_signal_masks": "voxelize_signal_masks_template.toml",
}


def load_toml_config(path: str | Path) -> dict[str, Any]:
    with Path(path).open("rb") as f:
        return tomllib.load(f)


def require_config_value(config: dict[str, Any], *keys: str) -> Any:
    """The value under nested keys; the error names the whole path."""
    value: Any = config
    for i, k in enumerate(keys):
        if not isinstance(value, dict) or k not in value:
            raise KeyError(f"config has no value {'.'.join(keys[: i + 1])}")
        value = value[k]
    return value


def list_templates() -> list[str]:
    return sorted(TEMPLATES)


def resolve_template_filename(name: str) -> str:
    """File name of a template, by its short name or its file name."""
    if name in TEMPLATES:
        return TEMPLATES[name]
    if name in TEMPLATES.values():
        return name
    raise KeyError(f"no template {name!r}; there are {list_templates()}")


def get_template_resource(name: str):
    return resources.files("stipple.sources") / "templates" / resolve_template_filename(name)


def as_template_path(name: str):
    """Context manager of a real path."""
    return resources.as_file(get_template_resource(name))


def read_template_text(name: str) -> str:
    return get_template_resource(name).read_text(encoding="utf-8")


def scaffold_template(name: str, target: str | Path, *, overwrite: bool = False) -> Path:
    """Copies a template to a file, or into a folder under its own name."""
    target = Path(target)
    if target.is_dir():
        target /= resolve_template_filename(name)
    if target.exists() and not overwrite:
        raise FileExistsError(f"{target} exists; pass overwrite=True to replace it")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(read_template_text(name), encoding="utf-8")
    return target
