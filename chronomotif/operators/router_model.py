"""A stored router: the nodes of ``routing.train`` over the held-in graphs of the sf0.1 log (tree, node, weight, feature, threshold, left, right, value)."""

TREES: list[tuple] = [
    (0, 0, 1.0, 'num_edges', 25.5, 1, 8, None),
    (0, 1, 1.0, 'cyclomatic_complexity', 12.5, 2, 5, None),
    (0, 2, 1.0, 'edge_locality_score', 8.589053, 3, 4, None),
    (0, 3, 1.0, None, None, None, None, 0.465277777778),
    (0, 4, 1.0, None, None, None, None, 0.603278688525),
    (0, 5, 1.0, 'ratio_nodes_ge_3', 0.8257575, 6, 7, None),
    (0, 6, 1.0, None, None, None, None, 0.563025210084),
    (0, 7, 1.0, None, None, None, None, 0.316770186335),
    (0, 8, 1.0, 'num_edges', 28.5, 9, 12, None),
    (0, 9, 1.0, 'edge_locality_score', 8.3898075, 10, 11, None),
    (0, 10, 1.0, None, None, None, None, 0.51724137931),
    (0, 11, 1.0, None, None, None, None, 0.171428571429),
    (0, 12, 1.0, 'edge_locality_score', 9.2016705, 13, 14, None),
    (0, 13, 1.0, None, None, None, None, 0.166666666667),
    (0, 14, 1.0, None, None, None, None, -0.489361702128),
    (1, 0, 0.1, 'num_edges', 19.5, 1, 8, None),
    (1, 1, 0.1, 'ratio_nodes_eq_2', 0.225, 2, 5, None),
    (1, 2, 0.1, 'num_edges', 17.5, 3, 4, None),
    (1, 3, 0.1, None, None, None, None, -0.412090332674),
    (1, 4, 0.1, None, None, None, None, 0.780657052301),
    (1, 5, 0.1, 'num_edges', 18.5, 6, 7, None),
    (1, 6, 0.1, None, None, None, None, -0.089422313732),
    (1, 7, 0.1, None, None, None, None, 0.546800246559),
    (1, 8, 0.1, 'ratio_nodes_eq_2', 0.4583335, 9, 12, None),
    (1, 9, 0.1, 'edge_locality_score', 10.8161495, 10, 11, None),
    (1, 10, 0.1, None, None, None, None, 0.051192688214),
    (1, 11, 0.1, None, None, None, None, -0.350813004368),
    (1, 12, 0.1, 'edge_locality_score', 9.619551, 13, 14, None),
    (1, 13, 0.1, None, None, None, None, -3.07875699934),
    (1, 14, 0.1, None, None, None, None, 0.92124300066),
    (2, 0, 0.1, 'num_edges', 19.5, 1, 8, None),
    (2, 1, 0.1, 'edge_locality_score', 7.573301, 2, 5, None),
    (2, 2, 0.1, 'cyclomatic_complexity', 7.5, 3, 4, None),
    (2, 3, 0.1, None, None, None, None, 1.145814240663),
    (2, 4, 0.1, None, None, None, None, 1.012936683789),
    (2, 5, 0.1, 'ratio_nodes_eq_2', 0.225, 6, 7, None),
    (2, 6, 0.1, None, None, None, None, 0.541380432642),
    (2, 7, 0.1, None, None, None, None, 0.129773452622),
    (2, 8, 0.1, 'ratio_nodes_eq_2', 0.4583335, 9, 12, None),
    (2, 9, 0.1, 'ratio_nodes_eq_2', 0.087121, 10, 11, None),
    (2, 10, 0.1, None, None, None, None, -0.020431125796),
    (2, 11, 0.1, None, None, None, None, 0.102923815327),
    (2, 12, 0.1, 'edge_locality_score', 9.619551, 13, 14, None),
    (2, 13, 0.1, None, None, None, None, -2.574200211638),
    (2, 14, 0.1, None, None, None, None, 0.797116473421),
    (3, 0, 0.1, 'num_edges', 19.5, 1, 8, None),
    (3, 1, 0.1, 'ratio_nodes_eq_2', 0.225, 2, 5, None),
    (3, 2, 0.1, 'ratio_nodes_ge_3', 0.8666665, 3, 4, None),
    (3, 3, 0.1, None, None, None, None, 0.592985831981),
    (3, 4, 0.1, None, None, None, None, -0.586149324672),
    (3, 5, 0.1, 'num_edges', 18.5, 6, 7, None),
    (3, 6, 0.1, None, None, None, None, -0.105804305472),
    (3, 7, 0.1, None, None, None, None, 0.444912136725),
    (3, 8, 0.1, 'edge_locality_score', 10.8161495, 9, 12, None),
    (3, 9, 0.1, 'ratio_nodes_eq_2', 0.2613635, 10, 11, None),
    (3, 10, 0.1, None, None, None, None, 0.048024718203),
    (3, 11, 0.1, None, None, None, None, -0.302657588406),
    (3, 12, 0.1, 'ratio_nodes_ge_3', 0.8257575, 13, 14, None),
    (3, 13, 0.1, None, None, None, None, 0.555620741786),
    (3, 14, 0.1, None, None, None, None, -0.84255398776),
    (4, 0, 0.1, 'num_edges', 19.5, 1, 8, None),
    (4, 1, 0.1, 'edge_locality_score', 7.573301, 2, 5, None),
    (4, 2, 0.1, 'cyclomatic_complexity', 7.5, 3, 4, None),
    (4, 3, 0.1, None, None, None, None, 0.983545821981),
    (4, 4, 0.1, None, None, None, None, 0.791766116902),
    (4, 5, 0.1, 'edge_locality_score', 7.892101, 6, 7, None),
    (4, 6, 0.1, None, None, None, None, -0.612530670688),
    (4, 7, 0.1, None, None, None, None, 0.279334766344),
    (4, 8, 0.1, 'ratio_nodes_eq_2', 0.087121, 9, 12, None),
    (4, 9, 0.1, 'edge_locality_score', 10.8161495, 10, 11, None),
    (4, 10, 0.1, None, None, None, None, -0.004270406655),
    (4, 11, 0.1, None, None, None, None, -0.548342546579),
    (4, 12, 0.1, 'num_edges', 27.5, 13, 14, None),
    (4, 13, 0.1, None, None, None, None, 0.090279022368),
    (4, 14, 0.1, None, None, None, None, -0.927924683502),
]
