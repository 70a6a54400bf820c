import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sqlkiln.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="sqlkiln-tests")
    yield s
    s.stop()


F1_CATALOG = [
    {"db_id": "shop", "table_names_original": ["orders", "customer"],
     "column_names_original": [[-1, "*"], [0, "order_id"], [0, "cust_id"], [1, "cust_id"], [1, "name"], [1, "extra"]],
     "column_types": ["text", "number", "number", "number", "text"],
     "primary_keys": [1, 3], "foreign_keys": [[2, 3]], "table_names": [], "column_names": []},
    {"db_id": "flat", "table_names_original": ["t"],
     "column_names_original": [[-1, "*"], [0, "a"]], "column_types": ["text", "text"],
     "primary_keys": [], "foreign_keys": [], "table_names": [], "column_names": []},
    {"db_id": "star", "table_names_original": ["b", "a"],
     "column_names_original": [[-1, "*"], [0, "x"], [1, "y"]], "column_types": ["text", "text", "text"],
     "primary_keys": [0], "foreign_keys": [], "table_names": [], "column_names": []},
]

F1_GOLDEN = {
    "shop": "Table customer, columns = [*,cust_id,name]\nTable orders, columns = [*,order_id,cust_id]\n"
            "Foreign_keys = [orders.cust_id = customer.cust_id]\nPrimary_keys = [orders.order_id,customer.cust_id]\n",
    "flat": "Table t, columns = [*,a]\nForeign_keys = []\n\nPrimary_keys = []\n",
    "star": "Table a, columns = [*,y]\nTable b, columns = [*,x]\nForeign_keys = []\n\nPrimary_keys = [a.*]\n",
}
