"""A small corpus of modules for queries and tests, written for this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: path and source of each file; main.py is the entry.
FILES = {
    "main.py": 'import os\nfrom shop import Basket, checkout\nfrom shop.prices import *\nimport shop.stock as stock\nimport requests\n\nRATE = 1\n\ndef run():\n    from shop.report import summary\n    basket = Basket()\n    return summary(checkout(basket), stock.count("tea"))\n\nif __name__ == "__main__":\n    print(run(), os.sep)\n',
    "shop/__init__.py": 'from .basket import Basket as Basket\nfrom .pay import checkout\nfrom .prices import price\n\n__all__ = ["Basket", "checkout", "price"]\n',
    "shop/basket.py": 'from __future__ import annotations\nfrom .stock import count\n\nclass Basket:\n    """What a customer takes."""\n    limit = 10\n\n    def add(self, name):\n        return count(name)\n\nclass Crate(Basket):\n    pass\n',
    "shop/pay.py": 'import json\nfrom shop import basket\n\nTAX = 7\n\ndef checkout(b):\n    return json.dumps({"tax": TAX, "limit": basket.Basket.limit})\n\ndef refund(b):\n    return -TAX\n',
    "shop/prices.py": '__all__ = ["price", "TABLE"]\nTABLE = {"tea": 3}\n_hidden = 1\n\ndef price(name):\n    return TABLE[name]\n\ndef unused_helper():\n    return _hidden\n',
    "shop/stock.py": 'import numpy\nSTOCK = {"tea": 4}\n\ndef count(name):\n    global STOCK\n    STOCK = dict(STOCK)\n    return STOCK.get(name, 0)\n',
    "shop/report.py": 'import importlib\nfrom typing import TYPE_CHECKING\n\nif TYPE_CHECKING:\n    from shop.basket import Basket\n\nformatter = importlib.import_module("shop.formats")\n\ndef summary(*parts):\n    return formatter.join(parts)\n',
    "shop/formats.py": 'print("formats loaded")\n\ndef join(parts):\n    return " ".join(map(str, parts))\n',
    "ring/__init__.py": "",
    "ring/a.py": "from ring.b import B\nA = B + 1\n",
    "ring/b.py": "from ring.a import A\nB = A * 2\n",
    "ring/c.py": "from ring import d\n\ndef c():\n    return d.d()\n",
    "ring/d.py": "from ring import c\n\ndef d():\n    return c.c()\n",
    "ring/e.py": "from ring.f import F\n\nclass E(F):\n    pass\n",
    "ring/f.py": "from ring.e import E\n\nclass F:\n    other = None\n",
    "broken.py": "def (:\n",
}
#: A second corpus: imports that are unused, missing, tolerated or stand in functions of a cycle, and a list that is read from outside.
MORE = {
    "main.py": 'import json\nimport left.a\nimport tools as t\nfrom math import pi, tau\n\nprint(t.__all__, tau)\ntry:\n    import tools.gone\nexcept ImportError:\n    pass\nimport tools.lost\n',
    "tools.py": '__all__ = ["use"]\n\ndef use():\n    from string import digits, hexdigits\n    return digits\n',
    "left/__init__.py": "",
    "left/a.py": "def a():\n    import left.b\n    return left.b\n",
    "left/b.py": "def b():\n    from left.a import a\n    return a\n",
}


def more_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MORE.items()), "path string, source string")


def sample_files(spark: SparkSession) -> DataFrame:
    """(path, source)"""
    return spark.createDataFrame(sorted(FILES.items()), "path string, source string")
