"""Field names from selector lambdas, so that tools can check them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class _Probe:
    """Stands for a model instance and notes which attribute is read."""

    def __init__(self, *names: str):
        object.__setattr__(self, "_names", names)

    def __getattr__(self, name: str) -> _Probe:
        return _Probe(*self._names, name)

    def _refuse(self, what: str) -> Any:
        raise ValueError(f"a field selector may only read one attribute, not {what} (at {'.'.join(self._names) or 'the model'})")

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        return self._refuse("call")

    def __getitem__(self, item: Any) -> Any:
        return self._refuse("index")

    def __bool__(self) -> bool:
        return self._refuse("test it")

    def __setattr__(self, name: str, value: Any) -> None:
        self._refuse("set it")


def _refusing(what: str) -> Callable[..., Any]:
    return lambda self, *args: self._refuse(what)


for _names, _what in (
    ("int float complex index round trunc floor ceil bytes str format", "convert it"),
    ("iter next len contains reversed", "go through it"),
    ("eq ne lt le gt ge hash", "compare it"),
    ("add radd sub rsub mul rmul truediv rtruediv floordiv rfloordiv mod rmod pow rpow matmul and rand or ror xor rxor lshift rshift neg pos abs invert", "compute with it"),
):
    for _name in _names.split():
        setattr(_Probe, f"__{_name}__", _refusing(_what))


def field_of(model: type, selector: Callable[[Any], Any]) -> str:
    """The name of the one attribute that the selector reads: ``field_of(User, lambda u: u.email)`` is "email"."""
    found = selector(_Probe())
    if not isinstance(found, _Probe):
        raise ValueError("a field selector must return the attribute it reads")
    names = found._names
    if len(names) != 1:
        raise ValueError(f"a field selector must read exactly one attribute, not {'.'.join(names) or 'none'}")
    return names[0]


@dataclass(frozen=True)
class FieldSpec:
    """A field of an instance emission, named by a string or by a selector."""

    selector: str | Callable[[Any], Any]
    transform: Any

    def name(self, model: type | None) -> str:
        return self.selector if isinstance(self.selector, str) else field_of(model or object, self.selector)
