"""Declared schemas of the tables the engine reads and writes, as DDL."""

BOX = "struct<x:int,y:int,w:int,h:int>"
POINTS = "array<struct<x:int,y:int>>"

IMAGE = "map_num string, kind string, height int, width int, n_channels int, data binary"
PARCEL = f"map_num string, parcel_id int, cx double, cy double, bbox {BOX}, area_px double, mask_area_px double, polygon {POINTS}, confidence double, source_tile struct<x:int,y:int>"
PARCEL_NUMBERED = f"map_num string, parcel_id int, detected_number int, cx double, cy double, confidence double, validation string, area_px double, bbox {BOX}, source string"
PARCEL_STATS = (
    "map_num string, id int, area_px double, area_frac double, cx int, cy int, bbox_x int, bbox_y int, bbox_w int, bbox_h int, aspect_ratio double,"
    " perimeter_px double, solidity double, compactness double"
)
READING = f"map_num string, source string, parcel_id int, cx double, cy double, bbox {BOX}, recognised_number int, confidence double, raw_text string, model string, rotation int, is_csv_target boolean"
CACHE = "seq long, map_num string, parcel_id int, number int, raw string, error string, model string, rotation int"
HOMOGRAPHY = (
    "pair string, map_a string, map_b string, rotation_b_deg double, edge_a string, edge_b string, shift_px double, stage1_score double, n_crossings_a int, n_crossings_b int,"
    " stage2_status string, shape_a array<int>, shape_b array<int>, boundary_parcels array<int>, h array<double>, b_offset array<int>, refinement struct<method:string,n_pairs:int>"
)
ORIENTATION = (
    "pair string, stage string, edge_a string, edge_b string, coarse_rot double, fine_rot double, total_rot double, phase_score double, ncc_2d double, density_a double,"
    " density_b double, density_sim double, combined_score double, error double, best_offset_px int, label string"
)
ADJACENCY_RANK = "map_num string, rank int, other string, score double, error double, edge string, rotation double, gap double, pair_key string"
CONTROL_POINT = (
    "pair string, method string, number int, parcel_a int, parcel_b int, cx_a double, cy_a double, cx_b double, cy_b double, cost double, residual double, n_dup_a int, n_dup_b int, is_csv_known boolean"
)
CLICKS = "pair string, map_a string, map_b string, parcels array<int>, clicks_a map<string,array<double>>, clicks_b map<string,array<double>>, common array<int>"
KEYPOINT = "map_num string, detector string, kp_id int, x float, y float, size float, angle float, response float, octave int, class_id int, descriptor array<float>"
COCO_IMAGE = "split string, id long, file_name string, width int, height int, source_map string"
COCO_ANNOTATION = "split string, id long, image_id long, category_id int, segmentation array<array<double>>, area double, bbox array<int>, iscrowd int"
STEP_METRIC = "map string, elapsed double, sharpness_before double, sharpness_after double, contrast_before double, contrast_after double"
