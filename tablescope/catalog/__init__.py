"""All registered queries."""

import importlib
import pkgutil


def load():
    from tablescope.catalog import common
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(common.QUERIES), dict(common.ORACLES)
