from .aggregates import (  # noqa: F401
    avg_term, count, count_distinct, group, group_concat, having, maximum, minimum, sample,
    sum_term, triple_count,
)
from .cycles import squares, triangles  # noqa: F401
from .joins import (  # noqa: F401
    bgp, compatible_join, exists, minus, mutual_pairs, optional, order_patterns, pattern_counts, product,
    reduce_by, star, union,
)
from .modifiers import (  # noqa: F401
    cap, desc, distinct, limit, order, paginate, row_index, slice_rows, top_k,
)
from .paths import (  # noqa: F401
    path_alt, path_closure, path_inv, path_neg, path_seq, path_step,
)
from .patterns import (  # noqa: F401
    ask, ask_result, construct, dataset, describe, distinct_quads, expand_iri, extend, from_graphs, in_graph,
    instances, keyword_filter, pattern, project, values, where,
)
